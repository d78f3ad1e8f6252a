"""Exact medians of groups of any size, without a group's values in one task.

A median is one or two ranks. Each pass takes, for every open rank, two values around it from 256 split points of a
mergeable sketch and counts exactly what lies below, at, between and above them: the rank is one of the two values,
or lies strictly between or beyond them. So every pass is right whatever the sketch errs, and leaves about a
hundredth of a group; when few values are left they are sorted. Three passes do for 10^11 values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.blocks import cut, joined

#: Split points of a pass, and the accuracy of the sketch: its rank error is one part in so many.
SPLITS, ACCURACY = 256, 10_000
#: Values of one group that are sorted at last.
FEW = 20_000


def medians(rows: DataFrame, keys: list[str], value: str, *, few: int = FEW, splits: int = SPLITS, accuracy: int = ACCURACY) -> DataFrame:
    """``keys, n, median``: of each group the number of its values and their exact median, nulls left out.

    As ``percentile(value, 0.5)``: the mean of both middle values where their number is even; NaN is the largest
    value; a group without values has null. Without keys there is one row.
    """
    names = [f"__k{i}" for i in range(len(keys))] or ["__k"]
    given = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), *([] if keys else [F.lit(0).alias("__k")]), F.col(value).cast("double").alias("v"))
    counts = given.groupBy(*names).agg(F.count("v").alias("n"))
    if not keys:
        counts = rows.sparkSession.range(1).select(F.lit(0).alias("__k")).join(counts, "__k", "left").select("__k", F.coalesce("n", F.lit(0)).alias("n"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    none = F.lit(None).cast("double")
    state = cut(counts.select(*names, "n", F.explode(ranks).alias("rank")).withColumns({"low": none, "high": none, "below": F.lit(0).cast("long"), "inside": F.col("n"), "answer": none}))
    values = given.where("v is not null")
    is_open = F.col("answer").isNull() & (F.col("inside") > few)
    while state.where(is_open).limit(1).count():
        state = cut(_narrowed(values, state.where(is_open), names, splits, accuracy).unionByName(state.where(~is_open)))
    left = _inside(values, state.where("answer is null and inside > 0"), names)
    sorted_left = left.groupBy(*names, "rank").agg(F.sort_array(F.collect_list("v")).alias("s"))
    found = F.coalesce("answer", F.get("s", (F.col("rank") - F.col("below")).cast("int")))
    out = joined(state, sorted_left, [*names, "rank"], "left").groupBy(*names).agg(F.first("n").alias("n"), F.avg(found).alias("median"))
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), "n", "median")


def _inside(values: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """Values strictly between the bounds of a rank; an absent bound holds nothing back."""
    both = joined(values, state, names)
    return both.where((F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high"))))


def _narrowed(values: DataFrame, state: DataFrame, names: list[str], splits: int, accuracy: int) -> DataFrame:
    """The open ranks with closer bounds, or with their answers."""
    keys, columns = [*names, "rank"], state.columns
    inside = _inside(values, state, names)
    shares = F.array(*(F.lit(k / splits) for k in range(splits + 1)))
    sketch = inside.groupBy(*keys).agg(F.percentile_approx("v", shares, accuracy).alias("p"))
    share = (F.col("rank") - F.col("below")) / F.greatest(F.col("inside") - 1, F.lit(1)) * splits
    a, b = F.get("p", F.greatest(F.floor(share) - 1, F.lit(0)).cast("int")), F.get("p", F.least(F.ceil(share) + 1, F.lit(splits)).cast("int"))
    bounded = joined(state, sketch, keys).select(*columns, a.alias("a"), b.alias("b"))
    v = F.col("v")
    counted = joined(inside.select(*keys, "v"), bounded.select(*keys, "a", "b"), keys).groupBy(*keys).agg(
        F.count_if(v < F.col("a")).alias("less"), F.count_if(v == F.col("a")).alias("at_a"), F.count_if((v > F.col("a")) & (v < F.col("b"))).alias("between"), F.count_if((v == F.col("b")) & (F.col("a") < F.col("b"))).alias("at_b"))
    now = joined(bounded, counted, keys)
    r = F.col("rank") - F.col("below")
    upto_a = F.col("less") + F.col("at_a")
    upto_b = upto_a + F.col("between")
    upto_c = upto_b + F.col("at_b")
    pick = lambda less, at_a, between, at_b, more: F.when(r < F.col("less"), less).when(r < upto_a, at_a).when(r < upto_b, between).when(r < upto_c, at_b).otherwise(more)
    low, high, below, none = F.col("low"), F.col("high"), F.col("below"), F.lit(None).cast("double")
    return now.select(
        *names, "n", "rank",
        pick(low, low, F.col("a"), low, F.col("b")).alias("low"), pick(F.col("a"), high, F.col("b"), high, high).alias("high"),
        pick(below, below, below + upto_a, below, below + upto_c).alias("below"), pick(F.col("less"), F.col("inside"), F.col("between"), F.col("inside"), F.col("inside") - upto_c).alias("inside"),
        pick(none, F.col("a"), none, F.col("b"), none).alias("answer"))
