"""The catalog: Parquet tables with set-wise upserts; a version's number is claimed by a rename."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.schemas import CATALOG, schema_of
from overlapse.workspace import materialise, remove


def one_a_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """The least row of each key, by its columns in turn: the same one on every run. Null keys are keys too."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns]) if rest else rows.distinct()


def _without(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    there = other.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).distinct()
    same = reduce(Column.__and__, [rows[c].eqNullSafe(there[f"_k{i}"]) for i, c in enumerate(key)])
    return rows.join(there, same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``, one a key, which win on equal keys."""
    return _without(old, new, key).unionByName(one_a_key(new, key))


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key isn't in ``old``, one a key."""
    return one_a_key(_without(new, old, key), key)


class Catalog:
    """Tables below one folder; a missing table reads as empty.

    A version of a table is written whole into a folder of its own and then renamed to the
    next number; the highest number is the table. Readers see the old version or the new
    one, never neither, and a lost writer leaves the old one in place. A writer whose number is
    taken meanwhile fails. The last ``KEPT`` versions stay, for readers that have begun.
    """

    #: Versions before the current one that are kept.
    KEPT = 2

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(x[2:]) for x in found if x.startswith("v-"))

    def _current(self, name: str) -> str | None:
        versions = self._versions(name)
        return f"v-{versions[-1]}" if versions else None

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        schema = schema_of(name)
        at = self._current(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{at}") if at else self.spark.createDataFrame([], schema)

    def replace(self, name: str, rows: DataFrame) -> None:
        schema = schema_of(name)
        number = max(self._versions(name), default=0) + 1
        draft = f"{self.root}/{name}/draft-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(draft)
        fs, at = self._fs(f"{self.root}/{name}/v-{number}")
        if fs.exists(at) or not fs.rename(self._fs(draft)[1], at):
            fs.delete(self._fs(draft)[1], True)
            raise RuntimeError(f"version {number} of {name} was written meanwhile")
        for old in self._versions(name)[: -1 - self.KEPT]:
            fs.delete(self._fs(f"{self.root}/{name}/v-{old}")[1], True)

    def upsert(self, name: str, rows: DataFrame) -> None:
        self.replace(name, upsert(self.read(name), rows.select(*schema_of(name).names), CATALOG[name][1]))

    def insert_absent(self, name: str, rows: DataFrame) -> None:
        old = self.read(name)
        self.replace(name, old.unionByName(insert_absent(old, rows.select(*schema_of(name).names), CATALOG[name][1])))

    def register(self) -> None:
        """Temporary views of all tables, for plain SQL."""
        for name in CATALOG:
            self.read(name).createOrReplaceTempView(name)


class FeatureCache:
    """Feature tables by content id, partitioned by its first two characters; present ids aren't computed again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, kind: str, schema) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{kind}").drop("prefix").select(*schema.names)

    def missing(self, kind: str, wanted: DataFrame, schema) -> DataFrame:
        return wanted.join(self.load(kind, schema).select("cid").distinct(), "cid", "left_anti")

    def save(self, kind: str, rows: DataFrame) -> None:
        rows.withColumn("prefix", F.substring(F.col("cid").cast("string"), 1, 2)).write.mode("append").partitionBy("prefix").parquet(f"{self.root}/{kind}")

    def remove(self, kind: str, gone: DataFrame) -> None:
        """Delete the features of the ids in ``gone`` (cid): the prefixes that hold any are written anew."""
        path = f"{self.root}/{kind}"
        held = self.spark.read.parquet(path)
        prefixes = held.join(gone.select("cid").distinct(), "cid", "left_semi").select("prefix").distinct()
        left = held.join(F.broadcast(prefixes), "prefix", "left_semi").join(gone.select("cid"), "cid", "left_anti")
        written = materialise(left, "features-left")
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for r in prefixes.toLocalIterator():  # at most as many as there are two-character prefixes
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/prefix={r['prefix']}"), True)
        written.write.mode("append").partitionBy("prefix").parquet(path)
        remove(written)

    def complete(self, kinds: dict) -> DataFrame:
        """Ids that have features of every kind."""
        out = None
        for kind, schema in kinds.items():
            ids = self.load(kind, schema).select("cid").distinct()
            out = ids if out is None else out.join(ids, "cid", "left_semi")
        return out
