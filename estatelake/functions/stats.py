"""Exact group statistics that stay bounded per task at any group size.

``percentile``/``median`` keep every distinct value of a group in one buffer, so a group
that holds a third of a 100 TB table would not fit. Here each value falls into a
coarse bucket (a monotone function of the value, so buckets are ordered like values), and two scans do the rest:

1. rows are counted and summed by (group, bucket) on the map side; only bucket totals are shuffled, never values. They give each
   bucket's range of ranks. Buckets have the same relative width at every
   magnitude, and a group has at most ``2 * 2200 * SCALE`` of them, whatever its row count;
2. the few buckets that hold a wanted rank are stored, so that the planner knows their size, and the rows are scanned again for
   the values in them, which are ranked within their bucket.

Results are exact and equal linear interpolation between closest ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.functions import sqltext as X
from estatelake.functions.scalars import finite
from estatelake.session import stored

SCALE = 2048
_NO_VALUE = -(2**62)


_LIFT = 1100 * SCALE  # above the exponent of the smallest number, so that both signs have their own range


def _bucket(v: Column) -> Column:
    """Ordered like the values; 0 is a bucket of its own."""
    width = F.floor(F.log2(F.abs(v)) * F.lit(SCALE)) + F.lit(_LIFT)
    spread = F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("bigint") * width)
    return F.coalesce(spread, F.lit(_NO_VALUE)).cast("bigint")


def group_stats(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    quantiles: dict[str, float],
    count: str | None = None,
    mean: str | None = None,
    low: str | None = None,
    high: str | None = None,
    std: str | None = None,
) -> DataFrame:
    """One row per key with the named exact quantiles and, if named, the other statistics.

    Rows with a missing key are left out; a group without any value stays, with count 0.
    ``std`` is the sample standard deviation.
    """
    val = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, finite(val).alias("_v"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.withColumn("_b", _bucket(F.col("_v")))
    v = F.col("_v")

    sums = [F.count(v).alias("_bn")]
    if mean or std:
        sums.append(F.sum(v).alias("_bs"))
    if low:
        sums.append(F.min(v).alias("_blow"))
    if high:
        sums.append(F.max(v).alias("_bhigh"))
    if std:
        sums += [F.avg(v).alias("_bmean"), F.var_pop(v).alias("_bvar")]
    buckets = rows.groupBy(*keys, "_b").agg(*sums)

    group = Window.partitionBy(*keys)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = buckets.withColumn("_upto", F.sum("_bn").over(upto)).withColumn(
        "_total", F.sum("_bn").over(group)
    )
    kept: dict[str, Column] = {}
    if count:
        kept[count] = F.col("_total")
    if mean or std:
        totals = totals.withColumn("_mean", F.try_divide(F.sum("_bs").over(group), F.col("_total")))
    if mean:
        kept[mean] = F.col("_mean")
    if low:
        kept[low] = F.min("_blow").over(group)
    if high:
        kept[high] = F.max("_bhigh").over(group)
    if std:
        gap = F.col("_bmean") - F.col("_mean")
        around_mean = F.sum(F.coalesce(F.col("_bn") * (F.col("_bvar") + gap * gap), F.lit(0.0))).over(group)
        kept[std] = F.sqrt(
            F.try_divide(F.greatest(around_mean, F.lit(0.0)), F.when(F.col("_total") > 1, F.col("_total") - 1))
        )

    place = {q: (F.col("_total") - 1) * F.lit(p) for q, p in quantiles.items()}
    first_rank = F.col("_upto") - F.col("_bn")

    def holds(rank: Column, start: Column, stop: Column) -> Column:
        return (start <= rank) & (rank < stop)

    wanted = [
        holds(edge(pos), first_rank, F.col("_upto"))
        for pos in place.values()
        for edge in (F.floor, F.ceil)
    ]
    # A group without values has only its empty bucket and must still give a row.
    is_wanted = reduce(lambda x, y: x | y, wanted, F.col("_total") == 0)
    opened = stored(totals.select(
        *keys, "_b", first_rank.alias("_first"), "_total", F.col("_upto"), F.col("_bn"),
        *[c.alias(name) for name, c in kept.items()],
    ).where(is_wanted).drop("_upto", "_bn"), "opened-buckets")

    carried = ["_first", "_total", *kept]
    counted = rows.join(opened, [*keys, "_b"]).groupBy(*keys, "_b", "_v").agg(
        F.count("_v").alias("_n"), *[F.max(c).alias(c) for c in carried])
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    n = F.col("_n")
    ranked = counted.withColumn("_stop", F.col("_first") + F.sum("_n").over(in_bucket))
    start, stop = F.col("_stop") - n, F.col("_stop")
    picks = []
    for i, pos in enumerate(place.values()):
        picks.append(F.max(F.when(holds(F.floor(pos), start, stop), v)).alias(f"_lo{i}"))
        picks.append(F.max(F.when(holds(F.ceil(pos), start, stop), v)).alias(f"_hi{i}"))
    out = ranked.groupBy(*keys).agg(
        F.max("_total").alias("_total"), *picks, *[F.max(name).alias(name) for name in kept]
    )
    between = [
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos))).alias(q)
        for i, (q, pos) in enumerate(place.items())
    ]
    return out.select(*keys, *kept, *between)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair, over rows where both are present.

    One aggregate without keys whose buffer holds, for each pair, count, means and co-moments around them; buffers of tasks are merged
    by the same update, so values far from zero lose no digits. No row is generated, and one row a task is shuffled.
    A pair with a constant column gives NULL.
    """
    base = df.select(*[finite(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    def corr(i: int, j: int) -> Column:
        x, y = (F.when(F.col(f"_{b}").isNotNull(), F.col(f"_{a}")) for a, b in ((i, j), (j, i)))  # over the rows of the pair
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # a rounded deviation of a constant need not be zero
        return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))

    found = base.agg(*[corr(i, j).alias(f"c{i}_{j}") for i, j in pairs])
    out = [(i, j, f"c{i}_{j}") for i, j in pairs] + [(j, i, f"c{i}_{j}") for i, j in pairs if i != j]
    rows = ", ".join(f"{X.quoted(columns[i])}, {X.quoted(columns[j])}, {c}" for i, j, c in out)
    return found.selectExpr(f"stack({len(out)}, {rows}) AS (col_a, col_b, corr)")


def fold_rows(wide: DataFrame, names: list[str], key: str, value: str, dtype: str = "bigint") -> DataFrame:
    """Turn the columns of a one-row frame into (key, value) rows."""
    cells = ", ".join(f"{X.quoted(n)}, CAST({X.name(n)} AS {dtype})" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {cells}) AS ({key}, {value})")


def stacked(df: DataFrame, columns: list[str], key: str, value: str, dtype: str, keep: list[str] | None = None) -> DataFrame:
    """One row per (row, column): the kept columns, the column name as ``key`` and its value."""
    cells = ", ".join(f"{X.quoted(c)}, CAST({X.name(c)} AS {dtype})" for c in columns)
    kept = [X.name(k) for k in keep or []]
    return df.selectExpr(*kept, f"stack({len(columns)}, {cells}) AS ({key}, {value})")
