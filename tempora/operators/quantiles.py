"""Exact quantiles of groups of any size.

``percentile`` holds every distinct value of a group in one buffer. Here a bounded sketch of each
group only says between which two values a wanted rank lies; the values between them are counted
and ranked exactly, and all smaller ones are one number. A group of n rows thus ranks at most some
``6 n / accuracy`` values for each wanted quantile, in a sort that can spill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.session import materialize


def brackets(x: DataFrame, keys: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """``keys, _n, _lo, _hi``: the rows of each group and, for each quantile, values that its two
    ranks lie between. The sketch errs by ``n / accuracy`` ranks at most and is asked three times
    as far to either side; groups of up to ``accuracy`` rows are bracketed by their extremes."""
    def at(shift: int):
        return F.percentile_approx("_v", [min(1.0, max(0.0, p + shift * 3 / accuracy)) for p in probs], accuracy)

    n, times = F.col("_n"), F.lit(len(probs))
    g = x.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                             at(-1).alias("_lo"), at(1).alias("_hi"))
    return g.select(*keys, "_n", F.when(n > accuracy, F.col("_lo")).otherwise(F.array_repeat("_min", times)).alias("_lo"),
                    F.when(n > accuracy, F.col("_hi")).otherwise(F.array_repeat("_max", times)).alias("_hi"))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """``keys``, ``n`` (rows with a value) and ``quantiles``: for each of ``probs`` the value at its
    rank, linear between the two nearest, as ``percentile`` gives it.

    Null and NaN values don't count; a group without others has ``n`` 0 and null quantiles; null keys
    are a group; an empty table gives no row; ties and repeated rows count as often as they come;
    further columns are ignored. Only counts of (group, value) and one row a group are shuffled; the
    rows are read twice, and the brackets are written once (``session.release`` deletes them).
    """
    if not probs or not all(0 <= p <= 1 for p in probs):
        raise ValueError(f"quantiles between 0 and 1 are needed, not {probs}")
    v = F.col(value).cast("double")
    x = df.select(*[F.col(k) for k in keys], F.when(~F.isnan(v), v).alias("_v"))
    near = materialize(brackets(x, keys, probs, accuracy), "brackets")
    counts = x.where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))

    right = near.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    # each value once a quantile: as itself inside the bracket, as null below it, not at all above
    met = counts.join(right, same).select(
        *keys, "_c", "_n", "_v", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(probs) - 1)).alias("j"),
                                                        F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))).alias("_b"))
    met = (met.where(F.col("_v") <= F.col("_b.hi"))
           .select(*keys, "_n", F.col("_b.j").alias("_j"), F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v"), "_c")
           .groupBy(*keys, "_j", "_n", "_v").agg(F.sum("_c").alias("_c")))

    through = F.sum("_c").over(Window.partitionBy(*keys, "_j").orderBy(F.asc_nulls_first("_v"))
                               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_j") + 1) * (F.col("_n") - 1)

    def at_rank(rank):
        return F.max(F.when((F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")), F.col("_v")))

    ranked = (met.withColumn("_to", through).withColumn("_p", place)
              .groupBy(*keys, "_j").agg(F.first("_p").alias("_p"), at_rank(F.floor("_p")).alias("_a"), at_rank(F.ceil("_p")).alias("_z")))
    part = F.col("_p") - F.floor("_p")
    missed = F.raise_error(F.lit("a rank lies outside the bracket of its sketch"))
    exact = (F.when(F.col("_a").isNull() | F.col("_z").isNull(), missed.cast("double"))
             .when(part == 0, F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_z")))
    found = (ranked.withColumn("_q", exact).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_q"))), lambda s: s["_q"]).alias("quantiles")))
    return near.join(found, same, "left").select(*keys, F.col("_n").alias("n"), "quantiles")
