"""Running state along each key's time line.

A window over a key keeps all its rows in one task, which fails when one key holds a large
share of the log. The rows of keys above ``hot_rows`` are therefore cut into splits of equal depth: a range partitioning by key and order samples
them and deals them into ranges of some ``hot_rows`` / ``SPLITS`` rows, however many fall on one day or one instant. The window
runs inside ``(key, split)``, one summary row per split carries the state across splits,
and both meet by an equi-join. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.operators.relational import BROADCAST_ROWS, HOT_ROWS
from lotlens.session import stored

BUCKET = "_bucket"
#: Splits of a key that holds just ``hot_rows``; there are at most as many in all per shuffle partition.
SPLITS = 8


def _split(rows: DataFrame, keys: Sequence[str], order: Sequence[str], count: int, hot_rows: int) -> DataFrame:
    """``count`` rows with the number of their split, which grows with the order of a key.

    Written once: where the ranges fall depends on a sample, and every reader needs the same ones.
    """
    most = SPLITS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = min(most, max(1, -(-count * SPLITS // hot_rows)))
    return stored(rows.repartitionByRange(splits, *keys, *order).withColumn(BUCKET, F.spark_partition_id().cast("bigint")), "splits")


class Timeline:
    """Rows of a log with the skew decision taken once for all running columns."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS):
        self.keys, self.order = list(keys), list(order)
        hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        n_hot, held = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
        self.split = n_hot > 0
        if n_hot == 0:
            self.rows = df.withColumn(BUCKET, F.lit(0).cast("bigint"))
        elif n_hot <= BROADCAST_ROWS:
            marks = F.broadcast(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_is_hot")))
            same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
            marked = df.join(marks, same, "left").drop(*[f"_h_{k}" for k in keys])
            cold = marked.where("_is_hot IS NULL").drop("_is_hot").withColumn(BUCKET, F.lit(0).cast("bigint"))
            self.rows = cold.unionByName(_split(marked.where("_is_hot").drop("_is_hot"), keys, order, held, hot_rows))
        else:
            self.rows = _split(df, keys, order, df.count(), hot_rows)

    def _window(self):
        return Window.partitionBy(*self.keys, BUCKET).orderBy(*self.order)

    def _buckets(self):
        return Window.partitionBy(*self.keys).orderBy(BUCKET)

    def _with(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """The rows with what earlier splits left; null keys count as equal."""
        names = [*self.keys, BUCKET]
        right = carry.select(*[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in carry.columns if c not in names])
        return rows.join(right, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])

    def previous(self, sticky: Sequence[str]) -> Timeline:
        """Adds ``prev_<c>``: the last non-null c of the earlier rows of the key."""
        before = self._window().rowsBetween(Window.unboundedPreceding, -1)
        inside = self.rows.withColumns({f"prev_{c}": F.last(c, ignorenulls=True).over(before) for c in sticky})
        if self.split:
            position = F.struct(*self.order)
            ends = self.rows.groupBy(*self.keys, BUCKET).agg(*[
                F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_last_{c}") for c in sticky
            ])
            earlier = self._buckets().rowsBetween(Window.unboundedPreceding, -1)
            carry = ends.select(*self.keys, BUCKET, *[
                F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in sticky
            ])
            inside = self._with(inside, carry).select(*self.rows.columns, *[
                F.coalesce(F.col(f"prev_{c}"), F.col(f"_carry_{c}")).alias(f"prev_{c}") for c in sticky
            ])
        self.rows = inside
        return self

    def running_count(self, flag: Column, name: str) -> Timeline:
        """Adds the number of flagged rows up to and including this one."""
        rows = self.rows.withColumn("_flag", F.coalesce(flag.cast("long"), F.lit(0).cast("long")))
        upto = self._window().rowsBetween(Window.unboundedPreceding, 0)
        inside = rows.withColumn(name, F.sum("_flag").over(upto))
        if self.split:
            sums = rows.groupBy(*self.keys, BUCKET).agg(F.sum("_flag").alias("_sum"))
            earlier = self._buckets().rowsBetween(Window.unboundedPreceding, -1)
            carry = sums.select(*self.keys, BUCKET, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
            inside = self._with(inside, carry).withColumn(name, F.col(name) + F.col("_carry")).select(*rows.columns, name)
        self.rows = inside.drop("_flag")
        return self

    def frame(self) -> DataFrame:
        return self.rows.drop(BUCKET)
