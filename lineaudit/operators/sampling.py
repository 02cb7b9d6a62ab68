"""Sampling, resampling, augmentation and batch planning."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_type

from lineaudit.functions import text as T
from lineaudit.functions.binding import let
from lineaudit.plans.ordered import order_statistics, row_positions, with_buckets
from lineaudit.session import stable


# -- draws -----------------------------------------------------------------------------

def digest_unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the given values."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("double") / 4294967296.0


def seeded_sample(rows: DataFrame, order: list[str], n: int, seed: int, exact: bool = False) -> DataFrame:
    """n rows drawn without replacement.

    ``exact`` picks the positions the standard seeded sampler picks in the
    given order; otherwise the rows with the smallest seeded digest are taken.
    """
    if not exact:
        return rows.orderBy(digest_unit(*[F.col(c) for c in order], F.lit(seed)), *order).limit(n)
    total = rows.count()
    picks = random.Random(seed).sample(range(total), min(n, total))
    return row_positions(rows, [], order).filter(F.col("position").isin(picks)).drop("position", "position_total")


def uniform_energies(n: Column, key: Column, seed: int = 0) -> Column:
    """Random baseline energies, one per line, reproducible per record."""
    # The count may stand for work on a whole text: bound once, not computed per line.
    return let(F.struct(key.alias("k"), n.alias("n")), lambda s: F.transform(
        F.filter(F.sequence(F.lit(0), s["n"]), lambda i: i < s["n"]), lambda i: digest_unit(s["k"], i, F.lit(seed))))


# -- bootstrap --------------------------------------------------------------------------

def poisson_cuts() -> list[float]:
    """Cumulative probabilities of Poisson(1), up to the last that a draw of 32 bits can reach."""
    cuts, term, i = [], math.exp(-1.0), 0
    total = term
    while total <= 1 - 2.0 ** -32:
        cuts.append(total)
        i += 1
        term /= i
        total += term
    return cuts


def poisson_weights(key: Column, iters: int, seed: int) -> Column:
    """Resample multiplicities of one record, one per iteration, from its own digest.

    Independent Poisson(1) counts are the large-n limit of drawing n of n with
    replacement and need no row number and no exchange of rows.
    """
    def count(u):
        c = F.lit(0)
        for q in poisson_cuts():
            c = c + (u >= q).cast("int")
        return c

    return F.transform(F.sequence(F.lit(0), F.lit(iters - 1)), lambda r: let(
        digest_unit(key, r, F.lit(seed)), count))


#: Numbers a task holds before it passes its sums on, and those of the weights it draws or adds up at a time.
_HELD = 4_000_000
_DRAWN = 1_000_000


def weighted_sums(rows: DataFrame, keys: list[str], parts: list[str], weights: str, iters: int) -> DataFrame:
    """Sums of part * weight per key and resample: ``keys`` and, for each of ``parts``, an array with one sum per resample.

    Arrays are added element by element where the rows are, so a row is never repeated per resample. A key has one
    row per task, or several if a task meets more keys than fit its memory.
    """
    fields = {f.name: f for f in rows.schema.fields}
    sums = T_.ArrayType(T_.DoubleType())
    schema = T_.StructType([*(T_.StructField(k, fields[k].dataType) for k in keys), *(T_.StructField(p, sums) for p in parts)])
    arrow = [to_arrow_type(fields[k].dataType) for k in keys]

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out():
            cols = list(zip(*held)) if keys else []
            table = np.stack(list(held.values()))
            flat = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(held) + 1) * iters, iters), pa.int32()), pa.array(table[:, i].ravel())) for i in range(len(parts))]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, arrow)), *flat], names=[*keys, *parts])

        for chunk in chunks:
            if not chunk.num_rows:
                continue
            w = chunk.column(weights).flatten().to_numpy().reshape(-1, iters)
            values = np.stack([chunk.column(p).to_numpy(zero_copy_only=False).astype(float) for p in parts], axis=1)
            named = zip(*(chunk.column(k).to_pylist() for k in keys)) if keys else [()] * chunk.num_rows
            for i, key in enumerate(named):
                total = held.get(key)
                if total is None:
                    if (len(held) + 1) * len(parts) * iters > _HELD and held:
                        yield out()
                        held.clear()
                    total = held[key] = np.zeros((len(parts), iters))
                total += values[i][:, None] * w[i]
        if held:
            yield out()

    return rows.select(*keys, *parts, weights).mapInArrow(run, schema)


def bootstrap_means(rows: DataFrame, value: str, key: str, by: list[str], iters: int, seed: int = 0) -> DataFrame:
    """Resampled means of ``value`` (by, rep, mean); equal values share nothing but their group."""
    base = rows.select(*by, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"), F.lit(1.0).alias("_one"),
                       poisson_weights(F.col(key), iters, seed).cast("array<tinyint>").alias("_w"))
    sums = weighted_sums(base, by, ["_v", "_one"], "_w", iters)
    # One row per task and group by now.
    each = sums.select(*by, F.posexplode(F.arrays_zip("_v", "_one")).alias("rep", "_s"))
    return each.groupBy(*by, "rep").agg(F.try_divide(F.sum("_s._v"), F.sum("_s._one")).alias("mean"))


def _draws(keys: list[str | None], iters: int, seed: int) -> np.ndarray:
    """``poisson_weights`` of many keys, one row per key."""
    tails = [f"{r}|{seed}".encode() for r in range(iters)]
    out = np.empty((len(keys), iters), dtype=np.int8)
    cuts = poisson_cuts()
    for i, key in enumerate(keys):
        # A missing part leaves its bar out, too.
        head = b"" if key is None else key.encode() + b"|"
        words = np.frombuffer(b"".join([hashlib.sha1(head + t).digest()[:4] for t in tails]), ">u4")
        out[i] = np.searchsorted(cuts, words / 4294967296.0, side="right")
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs; none if all are 0."""
    most = int(counts.max(initial=0))
    return counts.astype(np.min_scalar_type(most)).tobytes() if most else b""


def _unpacked(packed: list[bytes], iters: int) -> np.ndarray:
    out = np.zeros((len(packed), iters))
    for i, b in enumerate(packed):
        if b:
            out[i] = np.frombuffer(b, f"u{len(b) // iters}")
    return out


def _score_cells(rows: DataFrame, keys: list[str], key: str, iters: int, seed: int) -> DataFrame:
    """Weights of the positive and the other rows (``y``) of each of ``keys``, one count per resample, packed as ``p`` and ``n``.

    Weights are drawn once per ``key`` and batch of rows, so rows should come clustered by it, and travel as bytes. Keys
    have one row per task, or several if a task meets more than fit its memory.
    """
    fields = {f.name: f for f in rows.schema.fields}
    packed = [T_.StructField(c, T_.BinaryType()) for c in ("p", "n")]
    schema = T_.StructType([*(T_.StructField(k, fields[k].dataType) for k in keys), *packed])
    arrow = [to_arrow_type(fields[k].dataType) for k in keys]

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out():
            cols = [pa.array(c, t) for c, t in zip(zip(*held), arrow)]
            both = [pa.array([_packed(total[i]) for total in held.values()], pa.binary()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*cols, *both], names=[*keys, "p", "n"])

        for batch in chunks:
            for lo in range(0, batch.num_rows, _DRAWN // iters + 1):
                chunk = batch.slice(lo, _DRAWN // iters + 1)
                drawn = chunk.column(key).dictionary_encode()
                # The last row is that of a missing key.
                names = drawn.dictionary.to_pylist() + [None] * (drawn.null_count > 0)
                w = _draws(names, iters, seed)
                at = drawn.indices.fill_null(len(names) - 1).to_pylist()
                for i, y, named in zip(at, chunk.column("y").to_pylist(), zip(*(chunk.column(k).to_pylist() for k in keys))):
                    total = held.get(named)
                    if total is None:
                        if (len(held) + 1) * 2 * iters > _HELD and held:
                            yield out()
                            held.clear()
                        total = held[named] = np.zeros((2, iters), dtype=np.int64)
                    total[0 if y else 1] += w[i]
        if held:
            yield out()

    return rows.select(*keys, "y", key).mapInArrow(run, schema)


def bootstrap_auroc(rows: DataFrame, scores: list[str], positive: Column, key: str, by: list[str], iters: int,
                    seed: int = 0) -> DataFrame:
    """Resampled AUROC of each score, all scores of a row resampled together (by, score, rep, auc).

    The order of the scores is cut into buckets once, for all resamples. Tasks add the weights of equal scores;
    a bucket then runs over its distinct scores with arrays, some at a time, and buckets follow each other by their totals.
    A missing score ranks below all others. Resamples without both classes have no area.
    """
    # Clustered by key: its weights are drawn once for all groups and scores.
    narrow = stable(rows.withColumn("y", positive).filter("y IS NOT NULL").select(
        *by, "y", F.col(key).cast("string").alias("_key"), *[F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(scores)])
        .repartition("_key").sortWithinPartitions("_key"))
    pairs = F.inline(F.array(*[F.struct(F.lit(s).alias("score"), F.col(f"_s{i}").alias("_s")) for i, s in enumerate(scores)]))
    keys = [*by, "score"]
    cut = with_buckets(narrow.select(*by, "y", "_key", pairs), keys, ["_s"])
    cells = _score_cells(cut, [*keys, "_bucket", "_s"], "_key", iters, seed)
    kept = [f for f in cells.schema.fields if f.name in keys]
    totals = [T_.StructField(c, T_.ArrayType(T_.DoubleType())) for c in ("p", "n", "wins")]
    types = [to_arrow_type(f.dataType) for f in kept]

    def scan(group: tuple, table: pa.Table) -> pa.Table:
        s, missing = table.column("_s").to_numpy(), table.column("_s").is_null().to_numpy()
        order = np.lexsort((s, ~missing))
        s, missing = s[order], missing[order]
        # Rows of one score, from several tasks, count as one: they tie.
        new = np.concatenate([[True], ((s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))) | (missing[1:] != missing[:-1])])
        p_all, n_all, wins, tied = np.zeros(iters), np.zeros(iters), np.zeros(iters), np.zeros((2, 1, iters))
        for lo in range(0, len(order), _DRAWN // iters + 1):
            some = order[lo:lo + _DRAWN // iters + 1]
            starts = np.flatnonzero(new[lo:lo + len(some)])
            # The score that the last rows left open goes on, or is a score of its own.
            starts = np.concatenate([[0], starts + 1])
            p, n = (np.add.reduceat(np.concatenate([tied[i], _unpacked(table.column(c).take(pa.array(some)).to_pylist(), iters)]), starts)
                    for i, c in enumerate(("p", "n")))
            tied = np.stack([p[-1:], n[-1:]])
            p, n = p[:-1], n[:-1]
            wins += (p * (n_all + np.cumsum(n, axis=0) - n / 2)).sum(axis=0)
            p_all, n_all = p_all + p.sum(axis=0), n_all + n.sum(axis=0)
        p, n = tied[:, 0]
        wins, p_all, n_all = wins + p * (n_all + n / 2), p_all + p, n_all + n
        named = {f.name: pa.array([v.as_py()], t) for f, t, v in zip(kept, types, group)}
        return pa.table({**named, "_bucket": pa.array([group[len(kept)].as_py()], pa.int32()), "p": pa.array([p_all]), "n": pa.array([n_all]), "wins": pa.array([wins])})

    buckets = cells.groupBy(*keys, "_bucket").applyInArrow(scan, T_.StructType([*kept, T_.StructField("_bucket", T_.IntegerType()), *totals]))
    # One row per bucket and group from here on; arrays become rows only now.
    each = buckets.select(*keys, "_bucket", F.posexplode(F.arrays_zip("p", "n", "wins")).alias("rep", "_t"))
    before = Window.partitionBy(*keys, "rep").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.select(*keys, "rep", "_t.*", (F.sum("_t.n").over(before) - F.col("_t.n")).alias("_below"))
    return placed.groupBy(*keys, "rep").agg(F.try_divide(
        F.sum(F.col("wins") + F.col("p") * F.col("_below")), F.sum("p") * F.sum("n")).alias("auc"))


def index_interval(samples: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median and 95 % interval as elements of the sorted sample."""
    n = F.col("n")
    return order_statistics(samples, by, value, {
        "median": F.floor(n / 2), "lo": F.floor(0.025 * n), "hi": F.floor(0.975 * n)})


def linear_interval(samples: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median and 95 % interval with linear interpolation (one row per resample)."""
    return samples.groupBy(*by).agg(
        F.median(value).alias("median"), F.percentile(value, F.lit(0.025)).alias("lo"),
        F.percentile(value, F.lit(0.975)).alias("hi"), F.count(value).alias("n"))


# -- marker augmentation ---------------------------------------------------------------------

def augment(examples: DataFrame, k: int = 4, marker_prob: float = 0.5, positive_prob: float = 0.3, seed: int = 0,
            adversarial: bool = False) -> DataFrame:
    """k copies per example (column ``copy``); copy 0 is the original.

    Draws are digests of (seed, id, copy), so a copy is the same wherever and
    whenever it is made. In the adversarial mode only negative markers are
    placed, and never on a labelled line.
    """
    negative = F.array(*[F.lit(m) for m in T.NEGATIVE_MARKERS])
    positive = F.array(*[F.lit(m) for m in T.POSITIVE_MARKERS])

    def draw(name):
        return digest_unit(F.lit(seed), F.col("impl_id"), F.col("copy"), F.lit(name))

    def place(lines, at, marker):
        return let(F.struct(at.alias("at"), marker.alias("m")), lambda p: F.transform(
            lines, lambda x, i: F.when(i == p["at"], T.inject_marker(x, p["m"])).otherwise(x)))

    def pick(pool, name):
        return let(pool, lambda p: F.get(p, F.floor(draw(name) * F.size(p)).cast("int")))

    rows = examples.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lines = T.splitlines(F.col("impl_text"))
    all_idx = F.transform(lines, lambda x, i: i)
    if adversarial:
        free = F.array_except(all_idx, F.coalesce("buggy_lines", F.array().cast("array<int>")))
        out = let(pick(free, "line"), lambda at: F.when(at.isNotNull(), place(lines, at, pick(negative, "marker"))))
        out = F.when(draw("go") < marker_prob, out)
    else:
        first = F.when(draw("go") < marker_prob, place(
            lines, pick(all_idx, "line"), pick(F.concat(negative, positive), "marker"))).otherwise(lines)
        out = let(first, lambda ls: F.when(draw("go2") < positive_prob, place(
            ls, pick(all_idx, "line2"), pick(positive, "marker2"))).otherwise(ls))
    changed = F.when((F.col("copy") > 0) & (F.col("impl_text") != ""), T.join_lines(out))
    return rows.withColumn("impl_text", F.coalesce(changed, F.col("impl_text")))


# -- batches ----------------------------------------------------------------------------------------

def fixed_batches(rows: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """Add ``batch``: consecutive blocks of ``size`` rows along the order."""
    placed = row_positions(rows, by, order)
    return placed.withColumn("batch", F.floor(F.col("position") / size)).drop("position", "position_total")


def viable_specs(examples: DataFrame, trajectory: str = "system_trajectory", pairs: str = "sft_safe") -> DataFrame:
    """Specs a mixed batch can use: trajectory specs with both outcomes, pair specs with a labelled failure."""
    failing = F.col("status") == "FAIL"
    labelled = F.size("buggy_line_indices") > 0
    groups = examples.groupBy("source", "spec_id").agg(
        F.bool_or(F.col("status") == "PASS").alias("p"), F.bool_or(failing).alias("f"),
        F.bool_or(failing & labelled).alias("l"))
    ok = ((F.col("source") == trajectory) & F.col("p") & F.col("f")) | ((F.col("source") == pairs) & F.col("l"))
    return groups.filter(ok).select("source", "spec_id")


def mixed_batches(specs: DataFrame, n_trajectory: int = 2, n_pairs: int = 4, epoch: int = 0, seed: int = 0,
                  trajectory: str = "system_trajectory", pairs: str = "sft_safe") -> DataFrame:
    """Assign each viable spec to a batch of its epoch: ``n_trajectory`` and ``n_pairs`` specs each.

    One epoch is one shuffled pass over either pool; the shorter pool bounds
    the batches both pools fill, and its next epoch is its next shuffle. Every spec of either pool has a
    batch; the specs left over after the whole blocks of a pool form its last one, marked ``short``.
    """
    shuffled = specs.withColumn("_h", digest_unit(F.col("source"), F.col("spec_id"), F.lit(seed + 1000 * epoch)))
    placed = row_positions(shuffled, ["source"], ["_h", "spec_id"])
    per = F.when(F.col("source") == trajectory, n_trajectory).when(F.col("source") == pairs, n_pairs)
    full = F.floor(F.col("position_total") / per) * per
    return placed.filter(per.isNotNull()).select(
        "source", "spec_id", F.floor(F.col("position") / per).alias("batch"), (F.col("position") >= full).alias("short"))


def collate(batch_rows: DataFrame, batch_size: int, pad: int = 0) -> DataFrame:
    """One row per part of a batch: padded ids, contrast groups and labelled failing members.

    Rows need (batch, ord, source, spec_id, status, buggy_line_indices,
    input_ids). A batch is cut into consecutive parts of ``batch_size`` rows, the last one shorter, before it is
    gathered; every row is in one part, and indices count within it.
    """
    placed = row_positions(batch_rows, ["batch"], ["ord"]).withColumn("part", F.floor(F.col("position") / batch_size))
    item = F.struct((F.col("position") % batch_size).cast("int").alias("i"), "source", "spec_id", "status", "input_ids",
                    "buggy_line_indices")
    rows = placed.groupBy("batch", "part").agg(F.array_sort(F.collect_list(item)).alias("items"))
    width = F.array_max(F.transform("items", lambda x: F.size(x["input_ids"])))
    padded = let(width, lambda w: F.transform("items", lambda x: F.concat(
        x["input_ids"], F.array_repeat(F.lit(pad), w - F.size(x["input_ids"])))))
    traj = F.filter("items", lambda x: x["source"] == "system_trajectory")

    def group(spec):
        mine = F.filter(traj, lambda x: x["spec_id"] == spec)
        ok = F.transform(F.filter(mine, lambda x: x["status"] == "PASS"), lambda x: x["i"])
        bad = F.transform(F.filter(mine, lambda x: x["status"] == "FAIL"), lambda x: x["i"])
        return F.when((F.size(ok) > 0) & (F.size(bad) > 0), F.concat(F.slice(ok, 1, 1), bad))

    groups = F.filter(F.transform(F.array_distinct(F.transform(traj, lambda x: x["spec_id"])), group),
                      lambda g: g.isNotNull())
    broken = F.transform(F.filter("items", lambda x: (x["source"] == "sft_safe") & (x["status"] == "FAIL") & (
        F.size(x["buggy_line_indices"]) > 0)), lambda x: x["i"])
    return rows.select("batch", "part", F.size("items").alias("n"), padded.alias("input_ids"),
                       groups.alias("groups"), broken.alias("labelled_failing")).orderBy("batch", "part")


def keep_counts(examples: DataFrame, kept: Column, by: str = "source") -> DataFrame:
    """How many examples of each source came in and survived."""
    return examples.groupBy(by).agg(F.count("*").alias("n_in"), F.count_if(kept).alias("n_kept"))
