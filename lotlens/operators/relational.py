"""Relational building blocks that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.session import stored

BROADCAST_ROWS = 500_000
HOT_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the table is counted to be small; else the plain table.

    The count stops at ``max_rows + 1`` rows. Beyond the limit the join is left to a
    shuffle, where adaptive execution splits skewed partitions.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``; partial aggregates (each task sorts its own rows), so one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the least by ``order`` (columns of ``order`` must not be null)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Column, salts: int = 64,
    rank: str = "rank",
) -> DataFrame:
    """First ``n`` rows per key under a total order.

    Each key is first cut into ``salts`` slices by a hash of ``spread`` (a row id) and only
    the best ``n`` of a slice go on, so that no task sorts a whole hot group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(within)).where(F.col("_rn") <= n)
        .drop("_salt", "_rn")
        .withColumn(rank, F.row_number().over(across)).where(F.col(rank) <= n)
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10_000,
) -> DataFrame:
    """Count, mean and exact median of ``value`` per key, without gathering any group.

    A mergeable quantile sketch brackets the middle ranks; a second pass counts distinct
    values inside the bracket (all others collapse to one row below and one above), so the
    last window sorts a sliver of the group. A missed bracket stops the query. The sketch, one row per group, is
    stored and broadcast while it is small, so that a group with a large share of the rows stays spread.
    """
    keys = list(keys)
    margin = 3.0 / accuracy
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    edges = F.percentile_approx("_v", F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), accuracy)
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), edges.alias("_edges")
    )
    clipped = (
        F.when(F.col("_v") < F.col("_edges")[0], F.lit(float("-inf")))
        .when(F.col("_v") > F.col("_edges")[1], F.lit(float("inf")))
        .otherwise(F.col("_v"))
    )
    counted = (
        rows.join(checked_broadcast(stored(sketch, "sketch")), keys)
        .groupBy(*keys, "n", "mean", clipped.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_to", F.sum("_c").over(upto))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") >= rank) & (F.col("_to") - F.col("_c") < rank), F.col("_v")))

    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    middle = (F.col("_lo") + F.col("_hi")) / 2
    return (
        ranked.groupBy(*keys, "n", "mean").agg(at(low).alias("_lo"), at(high).alias("_hi"))
        .withColumn(
            "median",
            F.when(F.abs(middle) < float("inf"), middle)
            .otherwise(F.raise_error(F.lit("median bracket missed")).cast("double")),
        )
        .select(*keys, "n", "mean", "median")
    )


def lookup_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, hot_rows: int = HOT_ROWS,
    salts: int = 64,
) -> DataFrame:
    """Left join to a table with unique keys whose ``weight`` counts the rows of a key.

    Keys above ``hot_rows`` (there are at most rows / hot_rows of them) are looked up by
    broadcast when they are few; their rows then take a salted key through the shuffle
    join, where they find nothing and so stay spread out; so do rows with a null key. The
    table is stored first, as three steps read it.
    """
    keys = list(keys)
    right = stored(right, "lookup")
    extra = [c for c in right.columns if c not in keys]
    hot = checked_broadcast(
        right.where(F.col(weight) > hot_rows).select(*keys, F.struct(*extra).alias("_hot"))
    )
    cold = right.where(F.col(weight) <= hot_rows).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(0).alias("_k_salt"), F.struct(*extra).alias("_cold")
    )
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    marked = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | no_key, 1 + F.pmod(row_hash, F.lit(salts))).otherwise(0).cast("int")
    )
    cond = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_salt") == F.col("_k_salt")]
    joined = marked.join(cold, cond, "left")
    picked = [F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in extra]
    return joined.select(*left.columns, *picked)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, per_page: int = 50) -> DataFrame:
    """One page under a total order; the page number is clamped to the existing pages."""
    total = df.count()
    pages = max(1, -(-total // per_page))
    number = min(max(number, 1), pages)
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def append_key(*cols: Column) -> Column:
    """Stable id of a row from its natural key."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))
