"""Tables with versions: Parquet files in buckets by key, and one manifest a version.

A version is a file ``versions/<number>.json`` that names the data folders of every bucket. A change
writes new folders for the buckets that it touches, then publishes the next manifest by a rename that never replaces
a file: of two writers that started from one version the second is refused (``StaleVersion``) and
its folders are removed. Readers hold a manifest, so they never see half a change, and older versions stay
readable until ``forget_before``.

Keys are as in a primary key: a batch with a null key or with one key twice is refused (``BadBatch``), but for
``append``, which keeps a log. The driver handles manifests alone: at most ``buckets`` folders for each change since the
table was made or compacted; rows are written, joined and counted by tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class StaleVersion(RuntimeError):
    """Another change was published since the version that this one starts from."""


class BadBatch(ValueError):
    """A batch that holds a null key or one key twice."""


class VersionedTable:
    """A table at ``path``; ``VersionedTable.create`` makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> VersionedTable:
        """A new table with ``rows`` as version 0, in buckets by the hash of ``keys``."""
        table = cls(rows.sparkSession, path)
        base = {"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "files": {}}
        table._commit(base, -1, "create", table._written(rows, base), touched=None)
        return table

    # Versions

    def versions(self) -> list[int]:
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(name[:-5]) for f in self._fs.listStatus(folder) if (name := f.getPath().getName()).endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        stream = self._fs.open(self._at(f"versions/{version:010}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def forget_before(self, version: int) -> int:
        """Remove older manifests and the data folders that only they name; returns how many folders went."""
        kept = {f for v in self.versions() if v >= version for f in _folders(self.manifest(v))}
        gone = {f for v in self.versions() if v < version for f in _folders(self.manifest(v))} - kept
        for v in self.versions():
            if v < version:
                self._fs.delete(self._at(f"versions/{v:010}.json"), False)
        for f in gone:
            self._fs.delete(self._at(f), True)
        return len(gone)

    # Changes: each returns the version that it made; ``expected`` is the version that it starts from, by default the newest.

    def append(self, rows: DataFrame, expected: int | None = None) -> int:
        """Add all rows, whatever their keys: a log."""
        return self._change("append", expected, lambda base, touched: (rows, None), checked=None)

    def insert_ignore(self, rows: DataFrame, expected: int | None = None) -> int:
        """Add the rows whose keys are new; nothing is rewritten."""
        return self._change("insert_ignore", expected, lambda base, touched: (rows.join(self._rows(base, touched).select(*base["keys"]), base["keys"], "left_anti"), None), checked=rows)

    def upsert(self, rows: DataFrame, expected: int | None = None) -> int:
        """Rows with known keys replace them, the others are added; only buckets with a key of ``rows`` are rewritten."""

        def change(base: dict, touched: list[int]) -> tuple[DataFrame, list[int]]:
            old = self._rows(base, touched).join(rows.select(*base["keys"]), base["keys"], "left_anti")
            return old.unionByName(rows.select(*old.columns)), touched

        return self._change("upsert", expected, change, checked=rows)

    def replace_children(self, rows: DataFrame, expected: int | None = None) -> int:
        """The table's keys name a parent: all its rows give way to those in ``rows``."""

        def change(base: dict, touched: list[int]) -> tuple[DataFrame, list[int]]:
            old = self._rows(base, touched).join(rows.select(*base["keys"]).distinct(), base["keys"], "left_anti")
            return old.unionByName(rows.select(*old.columns)), touched

        return self._change("replace_children", expected, change, checked=rows, unique=False)

    def delete(self, keys: DataFrame, expected: int | None = None) -> int:
        """Remove the rows with these keys."""
        return self._change("delete", expected, lambda base, touched: (self._rows(base, touched).join(keys.select(*base["keys"]), base["keys"], "left_anti"), touched), checked=keys, unique=False)

    def compact(self, expected: int | None = None) -> int:
        """One folder for each bucket again."""
        return self._change("compact", expected, lambda base, touched: (self._rows(base), list(range(base["buckets"]))), checked=None)

    # Inside

    def _change(self, operation: str, expected: int | None, change: Callable, checked: DataFrame | None, unique: bool = True) -> int:
        known = self.versions()
        start = known[-1] if expected is None else expected
        if start != known[-1]:
            raise StaleVersion(f"version {start} was followed by {known[-1]}")
        base = self.manifest(start)
        rows, touched = change(base, None if checked is None else self._touched(checked, base, unique))
        return self._commit(base, start, operation, self._written(rows, base), touched)

    def _bucket(self, base: dict) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in base["keys"]]), F.lit(base["buckets"])).cast("int")

    def _touched(self, rows: DataFrame, base: dict, unique: bool) -> list[int]:
        """The buckets of a batch (at most ``buckets`` numbers come back); refuses null and, if ``unique``, repeated keys."""
        keys = base["keys"]
        times = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        lacking = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0))
        found = times.groupBy(self._bucket(base).alias("b")).agg(F.max("n").alias("n"), F.max(lacking).alias("lacking")).collect()
        if any(r["lacking"] for r in found):
            raise BadBatch("null_key")
        if unique and any(r["n"] > 1 for r in found):
            raise BadBatch("repeated_key")
        return sorted(r["b"] for r in found)

    def _rows(self, base: dict, touched: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(base["schema"])
        folders = [f"{self.path}/{f}" for b, own in base["files"].items() if touched is None or int(b) in touched for f in own]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame, base: dict) -> dict[str, list[str]]:
        """Bucket -> folders, of rows written to a new data folder."""
        name = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*[f.name for f in StructType.fromJson(base["schema"])]).withColumn(BUCKET, self._bucket(base))
        placed.repartition(base["buckets"], BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        found = (f.getPath().getName() for f in self._fs.listStatus(self._at(name)) if f.isDirectory())
        return {n.split("=")[1]: [f"{name}/{n}"] for n in found if n.startswith(f"{BUCKET}=")}

    def _commit(self, base: dict, start: int, operation: str, new: dict[str, list[str]], touched: list[int] | None) -> int:
        """Publish: folders of ``touched`` buckets give way to the new ones, else these are added."""
        gone = set(map(str, touched or []))
        files = {b: own for b, own in base["files"].items() if b not in gone}
        for b, own in new.items():
            files[b] = files.get(b, []) + own
        version = start + 1
        said = json.dumps(base | {"version": version, "parent": start, "operation": operation, "files": files}, sort_keys=True)
        jvm, draft, final = self.spark._jvm, self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"versions/{version:010}.json")
        stream = self._fs.create(draft, True)
        stream.write(said.encode())
        stream.close()
        self._fs.mkdirs(self._at("versions"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)  # fails where the file is there
        except Exception as e:
            if not self._fs.exists(final):
                raise
            self._fs.delete(draft, False)
            for folder in {f.rsplit("/", 1)[0] for own in new.values() for f in own}:
                self._fs.delete(self._at(folder), True)
            raise StaleVersion(f"version {version} was published by another") from e
        return version


def _folders(manifest: dict) -> set[str]:
    return {f for own in manifest["files"].values() for f in own}
