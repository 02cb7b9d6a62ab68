"""Benchmark items inside documents, found with an error budget.

Texts and items are compared as lower-case words joined by single blanks. An item of m
characters may differ by ``floor(m * RATE)`` edits. Cut into budget + 1 pieces, at least
one piece of it stays whole, so exact piece hits (Aho-Corasick) miss nothing within the
budget; each hit's surroundings are then verified with Myers' bit-parallel distance.

The items are the stated query set: they are read in blocks of ``BLOCK_CHARS`` characters,
and every block is laid against all documents. Items of fewer than ``LEAST_CHARS`` normalised
characters have no budget at the usual rate; they must stand whole, between word boundaries (none are
asked for in scripts written without blanks). Of these, formulas and items without any word are compared
exactly with their symbols kept, each symbol a word of its own. Only items of blanks hold nothing to search.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.05
LEAST_CHARS = 20
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")
_MARKED = re.compile(r"\w+|[^\w\s]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff"
                       "\uff66-\uff9f\U00020000-\U0003ffff]")
_HITS = "array<struct<item_id: bigint, distance: int, end: int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))


def plain(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def marked(text: str | None) -> str:
    """Like ``plain``, with every symbol and mark as a word of its own."""
    return " ".join(_MARKED.findall((text or "").lower()))


def _formula(text: str) -> bool:
    return any(c in "*/%\\" or unicodedata.category(c)[0] == "S" for c in text)


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether no word of a spaced script goes on across either end of ``text[start:end]``."""
    def free(at: int) -> bool:
        pair = text[at - 1:at + 1] if 0 < at < len(text) else ""
        return len(pair) < 2 or " " in pair or _UNSPACED.search(pair) is not None

    return free(start) and free(end)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 parts of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def best_end(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the item to any substring of ``text``, and the first end that reaches it."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.automaton = [], ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            budget = int(len(text) * rate)
            for offset, piece in pieces(text, budget):
                where.setdefault(piece, []).append((len(self.items), offset))
            whole = budget == 0 and len(text) < LEAST_CHARS
            self.items.append((item_id, len(text), budget, None if whole else masks(text)))
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict]:
        """The best occurrence of every item within its budget, by item."""
        if not self.items or not text:
            return []
        seen: dict[int, set[int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for end, (size, at) in self.automaton.iter(text):
            for item, offset in at:
                _, m, budget, peq = self.items[item]
                start = end + 1 - size - offset
                if peq is None:
                    if item not in best and _bounded(text, start, end + 1):
                        best[item] = (0, end + 1)
                    continue
                # Starts closer than the budget fall into the same or the next window.
                slot = start // (budget + 1)
                if slot in seen.setdefault(item, set()):
                    continue
                seen[item].add(slot)
                low = max(0, slot * (budget + 1) - budget)
                d, stop = best_end(peq, m, text[low:(slot + 1) * (budget + 1) + m + budget])
                if d <= budget and (d, low + stop) < best.get(item, (budget + 1, 0)):
                    best[item] = (d, low + stop)
        return [{"item_id": self.items[i][0], "distance": d, "end": e} for i, (d, e) in sorted(best.items())]


def _hits(items: list[tuple[int, str, bool]], rate: float, text: Column) -> Column:
    @F.arrow_udf(_HITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Matcher([(i, t) for i, t, symbols in items if not symbols], rate)
        formulas = Matcher([(i, t) for i, t, symbols in items if symbols], 0)
        for batch in batches:
            hits = [words.find(plain(t.as_py())) for t in batch]
            if formulas.items:
                hits = [h + formulas.find(marked(t.as_py())) for h, t in zip(hits, batch)]
            yield pa.array(hits, _ARROW)

    return run(text)


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str, bool]]]:
    """Normalised items and whether their symbols are kept, in lists of about ``block_chars`` characters."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // block_chars + 1
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().collect()
        texts = []
        for i, t in part:
            words = plain(t)
            symbols = not words or (len(words) < LEAST_CHARS and _formula(t))
            texts.append((i, marked(t) if symbols else words, symbols))
        yield sorted(x for x in texts if x[1])


def hits_column(items: DataFrame, text: Column, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> Column:
    """Array of (item_id, distance, end in the normalised text, with symbols where the item's are kept) for every item found in the text."""
    parts = [_hits(block, rate, text) for block in item_blocks(items, block_chars)]
    return reduce(lambda a, b: F.concat(a, b), parts)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, contaminated, items, distance): found item ids in ascending order, joined by commas, and the
    smallest distance (null without a hit). Null and empty texts hold nothing; repeated rows repeat."""
    rows = docs.select("doc_id", hits_column(items, F.col("text"), rate).alias("h"))
    ids = F.array_sort(F.array_distinct(F.transform("h", lambda x: x["item_id"])))
    return rows.select("doc_id", (F.size("h") > 0).alias("contaminated"),
                       F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("items"),
                       F.array_min(F.transform("h", lambda x: x["distance"])).alias("distance"))


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    return docs.where(F.size(hits_column(items, F.col("text"), rate)) == 0)
