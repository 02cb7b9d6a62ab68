"""Leak-free train/held split on squeezed spec text."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import text as T
from lineaudit.plans.ordered import row_positions
from lineaudit.plans.skew import attach


def hex_mod(digest: Column, modulus: int) -> Column:
    """A long hexadecimal number modulo a small one, four digits at a time."""
    parts = F.transform(
        F.sequence(F.lit(1), F.length(digest), F.lit(4)),
        lambda i: F.conv(F.substring(digest, i, F.lit(4)), 16, 10).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: (a * 65536 + p) % modulus)


def seeded_bucket(key: Column, seed: int, modulus: int = 1000) -> Column:
    return hex_mod(F.sha1(F.encode(F.concat(key, F.lit(str(seed))), "UTF-8")), modulus)


def spec_groups(examples: DataFrame, trajectory: str, pairs: str) -> DataFrame:
    """One row per squeezed spec hash with the kinds of examples it holds."""
    return examples.groupBy(T.squeeze_hash(F.col("spec_text")).alias("spec_hash")).agg(
        F.bool_or(F.col("source") == trajectory).alias("has_trajectory"),
        F.bool_or(F.col("source") == pairs).alias("has_pairs"))


def held_groups(groups: DataFrame, n_trajectory: int, pair_share: float, seed: int, exact: bool) -> DataFrame:
    traj = groups.filter("has_trajectory").select("spec_hash")
    if exact:
        # The shuffle permutes positions only; which hash sits where is looked
        # up by distributed row numbers, so no hash reaches the driver.
        places = list(range(traj.count()))
        random.Random(seed).shuffle(places)
        chosen = row_positions(traj, [], ["spec_hash"]).filter(F.col("position").isin(places[:n_trajectory]))
    else:
        rank = F.sha1(F.encode(F.concat("spec_hash", F.lit(str(seed))), "UTF-8"))
        chosen = traj.orderBy(rank, "spec_hash").limit(n_trajectory)
    pairs = groups.filter("NOT has_trajectory AND has_pairs").filter(
        seeded_bucket(F.col("spec_hash"), seed) < int(pair_share * 1000))
    return chosen.select("spec_hash").unionByName(pairs.select("spec_hash"))


def split(examples: DataFrame, n_trajectory: int = 30, pair_share: float = 0.10, seed: int = 42,
          trajectory: str = "system_trajectory", pairs: str = "sft_safe", exact: bool = False) -> DataFrame:
    """Add ``spec_hash`` and ``side`` (train or held); a spec's examples never part.

    The trajectory specs with the smallest seeded digest are held, which needs
    no driver state at all. ``exact`` reproduces the seeded shuffle of the sorted
    trajectory hashes instead, for which the driver permutes one integer per spec.
    """
    groups = spec_groups(examples, trajectory, pairs)
    held = held_groups(groups, n_trajectory, pair_share, seed, exact).withColumn("held", F.lit(True))
    rows = examples.withColumn("spec_hash", T.squeeze_hash(F.col("spec_text")))
    flagged = attach(rows, held, ["spec_hash"], ["held"])
    return flagged.withColumn(
        "side", F.when(F.coalesce("held", F.lit(False)), "held").otherwise("train")).drop("held")


def overlap(sides: DataFrame) -> DataFrame:
    """Hashes found on both sides: 0 for a sound split."""
    per = sides.groupBy("spec_hash").agg(F.count_distinct("side").alias("s"))
    return per.agg(F.count_if(F.col("s") > 1).alias("n_overlap"), F.count("*").alias("n_groups"))


def assert_disjoint(sides: DataFrame) -> DataFrame:
    """One row; evaluating it fails when a spec text sits on both sides."""
    return overlap(sides).select(
        F.assert_true(F.col("n_overlap") == 0, F.lit("spec texts on both sides of the split")).alias("ok"), "n_groups")
