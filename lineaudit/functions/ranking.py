"""In-row ranking over an energy array: highest first, ties to the lower index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineaudit.functions.binding import let


def rank_order(energies: Column) -> Column:
    """Line positions from most to least suspicious."""
    keyed = F.transform(energies, lambda e, i: F.struct((-e).alias("e"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def top_k(energies: Column, k: int) -> Column:
    return F.slice(rank_order(energies), 1, k)


def hit(order: Column, labels: Column, k) -> Column:
    """Does any of the first k ranked positions carry a label?"""
    return F.arrays_overlap(F.slice(order, 1, k), labels)


def argmax(energies: Column) -> Column:
    return (F.array_position(energies, F.array_max(energies)) - 1).cast("int")


def ordinal_ranks(energies: Column) -> Column:
    """0-based position of each line in the ascending stable sort."""
    asc = F.array_sort(F.transform(energies, lambda e, i: F.struct(e.alias("e"), i.alias("i"))))
    placed = F.transform(asc, lambda s, r: F.struct(s["i"].alias("i"), r.alias("r")))
    return F.transform(F.array_sort(placed), lambda s: s["r"])


def top_features(values: Column, k: int = 10) -> Column:
    """The k largest values with their positions."""
    return F.transform(top_k(values, k), lambda i: F.struct(
        i.alias("idx"), F.element_at(values, i + 1).alias("contrib")))


def in_range(labels: Column, n: Column) -> Column:
    return let(n, lambda m: F.filter(labels, lambda i: (i >= 0) & (i < m)))


def uniform_hit_probability(n: Column, b: Column, k: int) -> Column:
    """Chance that k of n lines drawn at random include one of b labelled lines."""
    def miss(nb):
        return F.aggregate(
            F.sequence(F.lit(0), F.least(F.lit(k), nb["n"]) - 1), F.lit(1.0),
            lambda acc, i: acc * F.greatest(nb["n"] - nb["b"] - i, F.lit(0)) / (nb["n"] - i))

    return F.when(n > 0, 1.0 - let(F.struct(n.alias("n"), b.alias("b")), miss))


def min_max(energies: Column) -> Column:
    span = F.struct(F.array_min(energies).alias("lo"), F.array_max(energies).alias("hi"))
    return let(span, lambda s: F.when(s["hi"] > s["lo"], F.transform(
        energies, lambda e: (e - s["lo"]) / (s["hi"] - s["lo"]))).otherwise(energies))
