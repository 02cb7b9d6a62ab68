"""In-row reducers from an energy array to one number. Empty arrays give 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineaudit.functions.binding import let


def total(e: Column) -> Column:
    return F.aggregate(e, F.lit(0.0), lambda a, x: a + x)


def mean(e: Column) -> Column:
    return total(e) / F.size(e)


def softplus(x: Column) -> Column:
    """log(1+exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pop_sd(e: Column) -> Column:
    return let(mean(e), lambda mu: F.sqrt(
        F.aggregate(e, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu)) / F.size(e)))


def _desc(e: Column) -> Column:
    return F.sort_array(e, asc=False)


def _nonempty(e: Column, value: Column) -> Column:
    return F.when(F.size(e) > 0, value).otherwise(F.lit(0.0))


def mean_top(e: Column, k: int) -> Column:
    return let(F.slice(_desc(e), 1, k), lambda top: total(top) / F.size(top))


def reducers(e: Column) -> dict[str, Column]:
    """The aggregator sweep: name to expression."""
    centred_max = F.array_max(e) - mean(e)
    raw = {
        "mean": mean(e),
        "max": F.array_max(e),
        "min": F.array_min(e),
        "last": F.element_at(e, -1),
        "sum": total(e),
        "softplus_sum": F.aggregate(
            e, F.lit(0.0), lambda a, x: a + F.log1p(F.exp(F.least(F.lit(20.0), x)))),
        "ms_max": centred_max,
        "ms_top3": mean_top(e, 3) - mean(e),
        "ms_top1_minus_min": F.array_max(e) - F.array_min(e),
    }
    return {k: _nonempty(e, v) for k, v in raw.items()}


def z_top_mean(e: Column, k: int) -> Column:
    """Mean of the k largest within-row z-scores (population sd, flat rows use 1)."""
    sd = F.coalesce(F.nullif(pop_sd(e), F.lit(0.0)), F.lit(1.0))
    return _nonempty(e, (mean_top(e, k) - mean(e)) / sd)


def z_scores(e: Column) -> Column:
    sd = F.coalesce(F.nullif(pop_sd(e), F.lit(0.0)), F.lit(1.0))
    return let(F.struct(mean(e).alias("mu"), sd.alias("sd")), lambda s: F.transform(
        e, lambda x: (x - s["mu"]) / s["sd"]))


def normalized_lse(e: Column, temperature: float) -> Column:
    """Temperature-scaled log-mean-exp: mean for large T, maximum for small T."""
    t = F.lit(float(temperature))
    return _nonempty(e, let(F.array_max(e), lambda m: m + t * F.log(
        F.aggregate(e, F.lit(0.0), lambda a, x: a + F.exp((x - m) / t)) / F.size(e))))


def log_sum_exp(e: Column) -> Column:
    return let(F.array_max(e), lambda m: m + F.log(
        F.aggregate(e, F.lit(0.0), lambda a, x: a + F.exp(x - m))))
