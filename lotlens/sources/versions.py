"""Keyed tables in parts, and one manifest that names the versions of all of them.

A table lies in ``parts`` parts by a hash of its key. A batch reads the parts its keys fall into and writes these alone, as files of its
own version; the bytes it moves follow the batch and not the table. The manifest of a batch names, for every table and part, the version that
holds it. Writing it is the commit: a reader takes the newest manifest, so it sees all tables after a batch or none of them, and a run that
stops half-way leaves the tables as they were. A repeated batch reads what its first run read, the manifest before it, and writes the
same files again.

Appended tables (events, snapshots) have one folder per batch; a reader takes those up to the newest manifest.

Rows die by tombstones: a batch writes the keys of the dead, and no table is rewritten for them. A tombstone holds for rows written before its
batch, so a listing that comes back later lives. Readers leave the dead out by an anti-join (broadcast while the keys are few); a part that
is rewritten for another reason loses its dead rows, and `compact` rewrites the parts that still hold some.

Choose ``parts`` so that a part stays below a few hundred MB: a batch reads and writes whole parts. A large part is written by several tasks, as
adaptive execution splits it at the advisory size; without it, by one. The manifest has one row per table and part.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lotlens.operators.relational import checked_broadcast
from lotlens.schemas import TABLES

MANIFEST = "table STRING, part INT, version BIGINT"
PARTS = 64


class VersionedTables:
    """Tables below one root; ``keys`` names the key columns of the keyed ones, all others are appended to."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, Sequence[str]], parts: int = PARTS):
        self.spark, self.root, self.keys, self.parts = spark, root.rstrip("/"), dict(keys), parts

    def _path(self, *names: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        path, files = self._path(folder)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))

    def batches(self) -> list[int]:
        """Numbers of the committed batches, oldest first."""
        done = []
        for number in self._numbers("manifest", "batch="):
            mark, files = self._path("manifest", f"batch={number}", "_SUCCESS")
            if files.exists(mark):
                done.append(number)
        return done

    def manifest(self, before: int | None = None) -> dict[tuple[str, int], int]:
        """Version of each table and part after the newest batch, or the newest one below ``before``."""
        done = [n for n in self.batches() if before is None or n < before]
        if not done:
            return {}
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/batch={done[-1]}").collect()
        return {(r.table, r.part): r.version for r in rows}

    def _schema(self, name: str) -> StructType:
        return StructType.fromDDL(TABLES[name])

    def columns(self, name: str) -> list[str]:
        return self._schema(name).names

    def part(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.parts)).cast("int")

    def touched(self, name: str, *frames: DataFrame) -> list[int]:
        """Parts of the table that the keys of the frames fall into; at most ``parts`` numbers."""
        found: set[int] = set()
        for frame in frames:
            found.update(r[0] for r in frame.select(self.part(name)).distinct().collect())
        return sorted(found)

    def read(self, name: str, parts: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
        """The table, or some parts of it, after the newest batch (below ``before``)."""
        reader = self.spark.read.schema(TABLES[name])
        if name in self.keys:
            wanted = None if parts is None else set(parts)
            held = self.manifest(before)
            paths = [f"{self.root}/{t}/version={v}/part={p}" for (t, p), v in sorted(held.items()) if t == name and (wanted is None or p in wanted)]
        else:
            done = [n for n in self.batches() if before is None or n < before]
            newest = done[-1] if done else -1
            paths = [f"{self.root}/{name}/version={n}" for n in self._numbers(name, "version=") if n <= newest]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self._without_dead(name, reader.parquet(*paths), before)

    def tombstones(self, name: str, before: int | None = None) -> list[DataFrame]:
        """Keys of dead rows with the batch that buried them, ``_buried``: one table per set of key columns."""
        done = [n for n in self.batches() if before is None or n < before]
        path, files = self._path("tombstones", name)
        if not done or not files.exists(path):
            return []
        found = []
        for folder in sorted(s.getPath().getName() for s in files.listStatus(path)):
            held = [n for n in self._numbers(f"tombstones/{name}/{folder}", "version=") if n <= done[-1]]
            if held:
                root = f"{self.root}/tombstones/{name}/{folder}"
                keys = folder.removeprefix("by=").split("+")
                schema = StructType([*(f for f in self._schema(name) if f.name in keys), StructField("version", LongType())])
                rows = self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/version={n}" for n in held])
                found.append(rows.groupBy(*keys).agg(F.max("version").alias("_buried")))
        return found

    def _without_dead(self, name: str, rows: DataFrame, before: int | None) -> DataFrame:
        graves = self.tombstones(name, before)
        if not graves:
            return rows
        columns = rows.columns
        rows = rows.withColumn("_written", F.regexp_extract("_metadata.file_path", "/version=([0-9]+)/", 1).cast("bigint"))
        for dead in graves:
            keys = [c for c in dead.columns if c != "_buried"]
            dead = checked_broadcast(dead.withColumnsRenamed({k: f"_dead_{k}" for k in keys}))
            same = [F.col(k) == F.col(f"_dead_{k}") for k in keys]
            rows = rows.join(dead, [*same, F.col("_written") < F.col("_buried")], "left_anti")
        return rows.select(*columns)

    def compact(self, batch: int, name: str) -> list[int]:
        """Rewrites the parts of a keyed table that may hold dead rows, as batch ``batch``; returns their numbers.

        Tombstones by the table's own key name their parts; others may touch any part written before them.
        """
        parts: set[int] = set()
        held = self.manifest(batch)
        for dead in self.tombstones(name, batch):
            if set(self.keys[name]) <= set(dead.columns):
                found = {r[0]: r[1] for r in dead.groupBy(self.part(name).alias("part")).agg(F.max("_buried")).collect()}
            else:
                newest = dead.agg(F.max("_buried")).first()[0]
                found = dict.fromkeys(range(self.parts), newest)
            parts.update(p for p, buried in found.items() if held.get((name, p), buried) < buried)
        if parts:
            self.commit(batch, {name: (self.read(name, parts, before=batch), parts)})
        return sorted(parts)

    def commit(
        self, batch: int, changed: dict[str, tuple[DataFrame, Iterable[int]]], appended: dict[str, DataFrame] | None = None,
        buried: dict[str, Sequence[DataFrame]] | None = None,
    ) -> None:
        """Writes the changed parts of keyed tables (all their rows), the rows to append and the keys of dead rows, then the manifest.

        ``buried`` holds tables of keys; their columns say by which columns rows die. Rows written by the same batch are not touched.
        """
        before = self.manifest(batch)
        after = dict(before)
        for name, (frame, parts) in changed.items():
            parts = sorted(parts)
            path = f"{self.root}/{name}/version={batch}"
            rows = frame.select(*[F.col(c) for c in self.columns(name)]).withColumn("part", self.part(name))
            rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(path)
            for part in parts:
                written, files = self._path(name, f"version={batch}", f"part={part}")
                if files.exists(written):
                    after[name, part] = batch
                else:
                    after.pop((name, part), None)  # the part has no rows left
        for name, frame in (appended or {}).items():
            frame.write.mode("overwrite").parquet(f"{self.root}/{name}/version={batch}")
        for name, graves in (buried or {}).items():
            for dead in graves:
                dead.distinct().write.mode("overwrite").parquet(f"{self.root}/tombstones/{name}/by={'+'.join(dead.columns)}/version={batch}")
        rows = [(t, p, v) for (t, p), v in sorted(after.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/batch={batch}")
        self._drop(before, after, batch)

    def _drop(self, before: dict, after: dict, batch: int) -> None:
        """Deletes part files that neither this manifest nor the one before names; a repeated batch still finds its input."""
        named = {*((t, p, v) for (t, p), v in before.items()), *((t, p, v) for (t, p), v in after.items())}
        for name in self.keys:
            for version in self._numbers(name, "version="):
                for part in self._numbers(f"{name}/version={version}", "part="):
                    if (name, part, version) not in named and version < batch:
                        path, files = self._path(name, f"version={version}", f"part={part}")
                        files.delete(path, True)
