"""What a chain of filters removes, and what it would remove in any other order.

Four filters look at one text each; the fifth fails exact copies of a smaller id's text. Copies are found with radix text
tries. Texts are dealt to ranges by adaptive prefixes: the cuts are the shortest prefixes that tell a digest-chosen
sample of distinct texts apart, so a range holds about the same number of distinct texts however alike their
beginnings are. A range arrives in text order and its texts go whole into a compressed trie whose terminals
hold the smallest id. What lies left of the newest text is complete, so the trie is traversed and emptied whenever it
holds ``TRIE_BYTES``; a task's memory does not grow with its range.

Only counts are wanted, so a terminal needs no list of its documents: a text carries its smallest id and, per part and label,
the number of rows with that id and of all others. Such entries merge in any order. Tasks merge the copies they
meet before anything is shuffled: of a text that a third of all rows share, one entry per ``TRIE_BYTES`` of a task's
distinct texts travels. Masks of failed filters are then counted per part, and all orders follow from those counts.

Null texts count as empty. Rows without an id never fail the copy filter and make no other row fail it; rows that repeat an
id and its text are not copies of each other. A document with several labels has a label if one row says so. A null
source is the part ''. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaudit.llm.common import settle
from lineaudit.plans.ordered import splitter_count

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of distinct texts a task holds before it passes them on.
TRIE_BYTES = 32 << 20
#: Counts a task holds before it passes them on.
COUNTS = 100_000
_SPECIAL = re.compile(rb"[#$%&*|]")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUED = bytes(range(128, 192))

_TALLY = ["part", "quality", "toxic", "first", "rest", "free"]
_TALLIES = "array<struct<part: string, quality: boolean, toxic: boolean, first: bigint, rest: bigint, free: bigint>>"
_TALLIES_ARROW = pa.list_(pa.struct(list(zip(_TALLY, [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]))))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that the UTF-8 text fails."""
    words = text.split()
    n = len(words)
    points = len(text.translate(None, _CONTINUED))
    return ((n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * len(text.translate(None, _NOT_UPPER)) > 2 * points) << 2
            | (_SPECIAL.search(text) is not None) << 3)


def merged(a: list, b: list) -> list:
    """Two entries of the same text as one. An entry is [smallest id, tallies, mask]; tallies count, per (part, quality,
    toxic), rows with that id, rows with a larger one and rows without any."""
    if b[0] is not None and (a[0] is None or b[0] < a[0]):
        a, b = b, a
    behind = b[0] is not None and b[0] != a[0]
    for key, (first, rest, free) in b[1].items():
        t = a[1].setdefault(key, [0, 0, 0])
        t[behind] += first
        t[1] += rest
        t[2] += free
    return a


class Trie:
    """A compressed trie over byte strings with a value at the end of each."""

    __slots__ = ("root", "bytes")

    def __init__(self):
        self.root, self.bytes = [b"", {}, None], 0

    @staticmethod
    def _shared(label: bytes, key: bytes, at: int) -> int:
        """Length of the common start of ``label`` and ``key[at:]``, by halving."""
        low, high = 0, min(len(label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if key.startswith(label[low:mid], at + low):
                low = mid
            else:
                high = mid - 1
        return low

    def node(self, key: bytes) -> list:
        """The node at which ``key`` ends, made if missing: [label, children by first byte, value]."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.bytes += len(key) - at + 200
                return child
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = self._shared(label, key, at)
            fork = [label[:n], {label[n]: child}, None]
            child[0] = label[n:]
            node[1][key[at]] = fork
            self.bytes += 200
            node, at = fork, at + n
        return node

    def add(self, key: bytes, value: list) -> None:
        node = self.node(key)
        node[2] = value if node[2] is None else merged(node[2], value)

    def values(self) -> Iterator[list]:
        """The values of all terminals in text order."""
        stack = [self.root]
        while stack:
            _, children, value = stack.pop()
            if value is not None:
                yield value
            stack.extend(children[c] for c in sorted(children, reverse=True))


def _collapsed(cuts: list[bytes]):
    """Documents to one row per distinct text and ``TRIE_BYTES``: range, text, mask, smallest id, tallies."""
    def rows(held: dict):
        texts, entries = list(held), held.values()
        tallies = [[dict(zip(_TALLY, (*k, *t))) for k, t in e[1].items()] for e in entries]
        yield pa.RecordBatch.from_arrays([
            pa.array([bisect_right(cuts, t) for t in texts], pa.int32()), pa.array(texts, pa.binary()), pa.array(map(text_mask, texts), pa.int32()),
            pa.array([e[0] for e in entries], pa.int64()), pa.array(tallies, _TALLIES_ARROW)], names=["range", "text", "mask", "low", "tallies"])

    def run(chunks):
        held, size = {}, 0
        for chunk in chunks:
            texts = chunk.column("text").cast(pa.binary()).to_pylist()
            for text, i, *key in zip(texts, *[chunk.column(c).to_pylist() for c in ("doc_id", *_TALLY[:3])]):
                entry = [i, {tuple(key): [1, 0, 0] if i is not None else [0, 0, 1]}, 0]
                known = held.get(text)
                if known is None:
                    size += len(text) + 300
                held[text] = entry if known is None else merged(known, entry)
                if size > TRIE_BYTES:
                    yield from rows(held)
                    held, size = {}, 0
        if held:
            yield from rows(held)

    return run


def _traversed(chunks):
    """Rows of one or more ranges in text order to counts (part, mask, quality, toxic, n)."""
    counts: dict[tuple, int] = {}

    def out():
        cols = list(zip(*[(*k, n) for k, n in counts.items()])) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()))],
                                         names=["part", "mask", "quality", "toxic", "n"])

    def count(trie):
        for _, tallies, mask in trie.values():
            for (part, *label), (first, rest, free) in tallies.items():
                for m, n in ((mask, first + free), (mask | COPY, rest)):
                    if n:
                        counts[part, m, *label] = counts.get((part, m, *label), 0) + n

    trie, last = Trie(), None
    for chunk in chunks:
        for text, mask, low, tallies in zip(*[chunk.column(c).to_pylist() for c in ("text", "mask", "low", "tallies")]):
            if trie.bytes > TRIE_BYTES and text != last:
                # Texts come in order: nothing in the trie can be met again.
                count(trie)
                trie = Trie()
                if len(counts) > COUNTS:
                    yield from out()
                    counts.clear()
            trie.add(text, [low, {(t["part"], t["quality"], t["toxic"]): [t["first"], t["rest"], t["free"]] for t in tallies}, mask])
            last = text
    count(trie)
    yield from out()


def separators(docs: DataFrame, n: int) -> list[bytes]:
    """At most n prefixes in text order: the shortest that tell the n distinct texts with the smallest digests apart."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digests = docs.select(F.xxhash64(text).alias("h")).distinct().orderBy(F.xxhash64("h"), "h").limit(n)
    sample = docs.select(text.alias("text")).join(F.broadcast(digests), F.xxhash64("text") == F.col("h")).groupBy("h").agg(F.min("text").alias("text"))

    def cut(chunks):
        last = None
        for chunk in chunks:
            found = []
            for text in chunk.column("text").to_pylist():
                if last is not None and text != last:
                    found.append(text[:Trie._shared(last, text, 0) + 1])
                last = text
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["cut"])

    # The n sampled texts meet in one task; the driver gets their separating prefixes.
    one = sample.select("text").coalesce(1).sortWithinPartitions("text")
    return sorted(r["cut"] for r in one.mapInArrow(cut, "cut binary").collect())


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, quality, toxic, n): documents per part, set of failed filters (bit 0 is A) and labels.

    Texts move twice at any size: to their labels, which are hashed per partition so that texts need no sort, and, once
    per task and distinct text, to their range.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality").eqNullSafe(1)).alias("_quality"), F.max(F.col("toxic").eqNullSafe(1)).alias("_toxic"))
    cuts = separators(docs, splitter_count(docs))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).join(known.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id", "part", F.coalesce("_quality", F.lit(False)).alias("quality"), F.coalesce("_toxic", F.lit(False)).alias("toxic"), "text")
    texts = rows.mapInArrow(_collapsed(cuts), f"range int, text binary, mask int, low bigint, tallies {_TALLIES}")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.repartitionById(n, F.pmod("range", F.lit(n))).sortWithinPartitions("range", "text")
    counts = ranged.mapInArrow(_traversed, "part string, mask int, quality boolean, toxic boolean, n bigint")
    return counts.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"))


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, seen, bit): the 120 orders of the five filters, 600 rows."""
    rows = []
    for p in permutations(FILTERS):
        seen = 0
        for step, letter in enumerate(p, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(p), step, seen, bit))
            seen |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, seen int, bit int")


def _cases() -> list[tuple[int, int, int]]:
    """(filters seen before, filter, number of orders): 80 cases."""
    size = len(FILTERS)
    return [(seen, 1 << b, factorial(seen.bit_count()) * factorial(size - 1 - seen.bit_count()))
            for b in range(size) for seen in range(1 << size) if not seen >> b & 1]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row per part,
    order and step, from the counts of masks alone."""
    spark = docs.sparkSession
    counts = settle(mask_counts(docs, labels))
    every = orders(spark)
    # What a step does depends on the set of filters before it, not on their order: 80 cases instead of 600. ``ways`` is
    # the number of orders in which a case occurs.
    cases = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("seen", "bit", "ways"), case)]) for case in _cases()])
    pairs = counts.select("*", F.inline(cases))
    n, fails = F.col("n"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    before = F.col("mask").bitwiseAND(F.col("seen")) != 0

    def total(condition):
        return F.sum(F.when(condition, n).otherwise(0))

    facts = pairs.groupBy("part", "seen", "bit", "ways").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~before & F.col("quality")).alias("good_lost"),
        total(fails & ~before & F.col("toxic")).alias("toxic_lost"))
    value = facts.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("ways")).alias("shapley"))
    out = facts.join(value, ["part", "bit"]).join(F.broadcast(every), ["seen", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
