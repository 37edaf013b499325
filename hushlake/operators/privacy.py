"""Differentially private counts, sums, averages and selections, and budgets by tenant."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import by_key, spend
from ..functions.prf import uniform
from ..sources.keys import Key


def positive(**values: float) -> None:
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive")


def laplace(u: Column, sensitivity: float, epsilon: float) -> Column:
    """Laplace noise from a uniform number, by the inverse distribution function."""
    positive(sensitivity=sensitivity, epsilon=epsilon)
    x = u - 0.5
    return -F.lit(sensitivity / epsilon) * F.signum(x) * F.log(F.greatest(1 - 2 * F.abs(x), F.lit(2.0**-60)))


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    positive(sensitivity=sensitivity, epsilon=epsilon, delta=delta)
    if delta >= 1:
        raise ValueError("delta must be below 1")
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def gaussian(u: Column, v: Column, sigma: Column | float) -> Column:
    """Gaussian noise from two uniform numbers (Box and Muller)."""
    sigma = sigma if isinstance(sigma, Column) else F.lit(sigma)
    return sigma * F.sqrt(-2 * F.log(F.greatest(u, F.lit(2.0**-60)))) * F.cos(2 * math.pi * v)


def laplace_variance(sensitivity: float, epsilon: float) -> float:
    positive(sensitivity=sensitivity, epsilon=epsilon)
    return 2 * (sensitivity / epsilon) ** 2


def gaussian_variance(sensitivity: float, epsilon: float, delta: float) -> float:
    return gaussian_sigma(sensitivity, epsilon, delta) ** 2


def noise_variance(kind: Column, sensitivity: Column, epsilon: Column, delta: Column) -> Column:
    """Variance of the noise of a count (Laplace), or of a sum or average (Gaussian), by row; null where the parameters allow no noise."""
    gauss = 2 * F.log(1.25 / delta) * F.pow(sensitivity / epsilon, F.lit(2))
    fits = (sensitivity > 0) & (epsilon > 0)
    return F.when(fits & (kind == "count"), 2 * F.pow(sensitivity / epsilon, F.lit(2))).when(fits & kind.isin("sum", "average") & (delta > 0) & (delta < 1), gauss)


def draws(noise: Key, query: str, group: list[str], release: Column | None = None) -> tuple[Column, Column]:
    """Two uniform numbers fixed by the noise key, the query, the group and the release: a retried task draws the same.

    Every release over data that may have changed needs a release of its own, or the difference of two would be exact.
    """
    names = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group]
    own = [F.lit(query), *([] if release is None else [release.cast("string")]), *names]
    return uniform(noise, *own, F.lit("1")), uniform(noise, *own, F.lit("2"))


def private_count(grouped: DataFrame, noise: Key, query: str, group: list[str], epsilon: float, sensitivity: float = 1.0, release: Column | None = None) -> DataFrame:
    """noisy_count of rows (group, true_count, keys)."""
    u, _ = draws(noise, query, group, release)
    return grouped.select(*group, (F.col("true_count") + laplace(u, sensitivity, epsilon)).alias("noisy_count"))


def private_sum(grouped: DataFrame, noise: Key, query: str, group: list[str], sensitivity: float, epsilon: float, delta: float, release: Column | None = None) -> DataFrame:
    """noisy_sum of rows (group, true_sum, keys)."""
    return grouped.select(*group, (F.col("true_sum") + gaussian(*draws(noise, query, group, release), gaussian_sigma(sensitivity, epsilon, delta))).alias("noisy_sum"))


def private_average(grouped: DataFrame, noise: Key, query: str, group: list[str], value_range: float, epsilon: float, delta: float, release: Column | None = None) -> DataFrame:
    """noisy_average of rows (group, true_average, true_count, keys); the sensitivity is value_range / count, of at least one row."""
    sigma = gaussian_sigma(value_range, epsilon, delta) / F.col("true_count")
    return grouped.filter("true_count >= 1").select(*group, (F.col("true_average") + gaussian(*draws(noise, query, group, release), sigma)).alias("noisy_average"))


def private_selection(candidates: DataFrame, noise: Key, query: str, group: list[str], sensitivity: float, epsilon: float) -> DataFrame:
    """The selected candidate of each group, of rows (group, candidate, utility, keys): the exponential mechanism.

    Gumbel noise on epsilon * utility / (2 * sensitivity) and the largest wins: the same law as weights, in one aggregation.
    """
    positive(sensitivity=sensitivity, epsilon=epsilon)
    u = uniform(noise, F.lit(query), *[F.coalesce(F.col(g).cast("string"), F.lit("")) for g in group], F.col("candidate"))
    gumbel = -F.log(-F.log(F.least(F.greatest(u, F.lit(2.0**-60)), F.lit(1 - 2.0**-53))))
    best = F.max_by("candidate", F.lit(epsilon / (2 * sensitivity)) * F.col("utility") + gumbel)
    return candidates.groupBy(*group).agg(best.alias("selected"))


def budget_fold(requests: DataFrame, order: list[str]) -> DataFrame:
    """(tenant_id, seq, epsilon, accepted, remaining, warning) of requests (tenant_id, seq, epsilon, total) in order; refused ones cost nothing.

    Where requests have a column ``reset`` (boolean), the tenant's budget is full again before a row with it set. Where they have a column ``spent``
    (double), a tenant begins with that consumed already.
    """
    if "reset" in requests.columns:
        # Each reset begins an account of its own.
        w = Window.partitionBy("tenant_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        account = F.sum(F.coalesce("reset", F.lit(False)).cast("int")).over(w)
    else:
        account = F.lit(0).cast("long")
    spent = F.coalesce("spent", F.lit(0.0)) if "spent" in requests.columns else F.lit(0.0)
    rows = requests.withColumns({"__account": account, "__spent": spent})

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        seq, epsilon, total, before = row
        consumed = state.get("consumed", before)
        fits, left, warning = next(spend(iter([(epsilon, total)]), consumed))
        state["consumed"] = consumed + epsilon if fits else consumed
        yield seq, epsilon, fits, left, warning

    schema = "tenant_id string, __account long, seq long, epsilon double, accepted boolean, remaining double, warning boolean"
    return by_key(rows, ["tenant_id", "__account"], order, ["seq", "epsilon", "total", "__spent"], step, schema).drop("__account")


def budget_state(folded: DataFrame) -> DataFrame:
    """Of each tenant: requests, accepted, consumed, remaining, exhausted."""
    last = F.max_by("remaining", "seq")
    return folded.groupBy("tenant_id").agg(F.count("*").alias("requests"), F.count_if("accepted").alias("accepted"), F.sum(F.when(F.col("accepted"), F.col("epsilon")).otherwise(0.0)).alias("consumed"), last.alias("remaining"), (last <= 1e-12).alias("exhausted"))
