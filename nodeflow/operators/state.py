"""Versioned state tables in the shared folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS, COMPACTIONS, SCHEMA = "commits", "compactions", "schema.txt"
OWNER = "owner.txt"  # readable by Spark, which skips names with a leading underscore


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes replace rows of the same key and add the others."""
    kept = table.join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes.select(*table.columns))


def insert_new(table: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table with the rows of new keys, rejected rows whose key exists)."""
    known = table.select(key)
    return (table.unionByName(new.join(known, key, "left_anti").select(*table.columns)),
            new.join(known, key, "left_semi"))


class StateStore:
    """State of a stream in a shared folder.

    ``data/version=V/<table>`` holds whole tables of a version. ``log/<table>`` holds tables as a log: a version
    adds only the rows it touched (or marks them as deleted), dealt into hash buckets of the key; a read takes
    the newest row of each key; a compaction folds all versions up to one into ``base-V``. A version or
    compaction counts once its small file in ``commits`` or ``compactions`` is there, so a batch that is run
    again either finds its result or overwrites what a lost run left behind.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- small files

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _put(self, name: str, text: str) -> None:
        """Write a small file under another name first, so it is there as a whole or not at all."""
        path, aside = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{name}.part")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(aside, path):
            self._fs.delete(path, False)
            self._fs.rename(aside, path)

    def _numbers(self, folder: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(folder) if n.endswith(".json")]

    def versions(self) -> list[int]:
        """Committed versions, by one listing."""
        return self._numbers(COMMITS)

    def committed(self, version: int) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{COMMITS}/{version:012d}.json"))

    def commits(self, schema: str) -> DataFrame:
        """What versions noted when they were written: one small row each."""
        if not self.versions():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.root}/{COMMITS}")

    def last_commit(self) -> dict:
        known = self.versions()
        if not known:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/{COMMITS}/{known[-1]:012d}.json").first()[0])

    def claim(self, owner: str) -> None:
        """Tie the state to the stream that writes it. Another stream, such as one restarted with a new
        checkpoint, counts its batches from 0 again and would find them all done, so it is refused."""
        path = self._path(f"{self.root}/{OWNER}")
        if self._fs.exists(path):
            known = self.spark.read.text(path.toString()).first()
            if known is not None and known[0] != owner:
                raise ValueError(f"{self.root} belongs to stream {known[0]}, not {owner}; use its checkpoint or a new folder")
            if known is not None:
                return
        self._put(OWNER, owner)

    # ---- versions

    def _dir(self, version: int, name: str) -> str:
        return f"{self.root}/data/version={version}/{name}"

    def _log(self, name: str, kind: str, version: int) -> str:
        return f"{self.root}/log/{name}/{kind}-{version}"

    def write(self, version: int, tables: dict[str, DataFrame] | None = None, changes: dict[str, tuple[DataFrame, list[str]]] | None = None,
              notes: Callable[[], dict] | None = None) -> None:
        """Write whole ``tables`` and logged ``changes`` (rows, keys); ``notes()`` is called after that and
        goes into the commit. A boolean column ``deleted`` of changes marks keys that leave."""
        if self.committed(version):
            return
        for name, table in (tables or {}).items():
            table.write.mode("overwrite").parquet(self._dir(version, name))
        for name, (rows, keys) in (changes or {}).items():
            self._append(name, "version", version, rows if "deleted" in rows.columns else rows.withColumn("deleted", F.lit(False)), keys)
        self._put(f"{COMMITS}/{version:012d}.json", json.dumps({"version": version, **(notes() if notes else {})}))

    def _append(self, name: str, kind: str, version: int, rows: DataFrame, keys: list[str]) -> None:
        bucket = F.pmod(F.xxhash64(*keys[:1]), F.lit(self.buckets)).cast("int")
        marked = rows.withColumn("written", F.lit(version).cast("bigint")).withColumn("bucket", bucket)
        if not self._fs.exists(self._path(f"{self.root}/log/{name}/{SCHEMA}")):
            self._put(f"log/{name}/{SCHEMA}", marked.schema.json())
        # buckets lie together, so a read of some of them skips the files of the others
        marked.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(self._log(name, kind, version))

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        if version is None:
            if not known:
                return None
            version = known[-1]
        return self.spark.read.parquet(self._dir(version, name))

    def _bases(self) -> list[int]:
        return self._numbers(COMPACTIONS)

    def read_log(self, name: str, keys: list[str], until: int | None = None, buckets: list[int] | None = None,
                 unchanging: bool = False) -> DataFrame | None:
        """The table as of version ``until`` (the last): the newest row of each key, without deleted ones.
        ``unchanging`` logs hold each key once and are read without grouping."""
        versions = [v for v in self.versions() if until is None or v <= until]
        if not versions:
            return None
        base = max((b for b in self._bases() if b <= versions[-1]), default=None)
        folders = [self._log(name, "version", v) for v in versions if base is None or v > base]
        if base is None and not self._fs.exists(self._path(folders[0])):
            raise ValueError(f"version {until} of {name} is older than what the state keeps")
        if base is not None:
            folders.insert(0, self._log(name, "base", base))
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/log/{name}/{SCHEMA}").first()[0]))
        rows = self.spark.read.schema(schema).parquet(*folders)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        columns = [c for c in schema.names if c not in ("written", "bucket", "deleted")]
        if len(folders) > 1 and not unchanging:
            rows = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), "written").alias("_row")).select("_row.*")
        return rows.where(~F.col("deleted")).select(*columns)

    def bucket_of(self, keys: Column) -> Column:
        return F.pmod(F.xxhash64(keys), F.lit(self.buckets)).cast("int")

    def compact(self, tables: dict[str, list[str]], retain: int = 10) -> None:
        """Fold all versions of the logs ``tables`` (name -> keys) into one base. Versions and bases that no
        read of the last ``retain`` versions needs are removed; what the commits noted stays."""
        known = self.versions()
        if not known or known[-1] in self._bases():
            return
        version = known[-1]
        for name, keys in tables.items():
            self._append(name, "base", version, self.read_log(name, keys, version).withColumn("deleted", F.lit(False)), keys)
        self._put(f"{COMPACTIONS}/{version:012d}.json", json.dumps({"version": version}))
        bases = self._bases()
        keep = max((b for b in bases if b <= version - retain), default=None)
        if keep is None:
            return
        for name in tables:
            for folder in self._names(f"log/{name}"):
                kind, _, number = folder.partition("-")
                if number and (int(number) < keep or kind == "version" and int(number) == keep):
                    self._fs.delete(self._path(f"{self.root}/log/{name}/{folder}"), True)
        for b in bases:
            if b < keep:
                self._fs.delete(self._path(f"{self.root}/{COMPACTIONS}/{b:012d}.json"), False)


def node_members(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Append member vectors (node_id, row_id, embedding); a member is kept once."""
    return memory.unionByName(new.join(memory.select("node_id", "row_id"), ["node_id", "row_id"], "left_anti"))
