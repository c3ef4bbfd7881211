"""Table mutations as new versions: insert-ignore, upsert, update-from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys), keys, "left_anti")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new_rows(old, new, keys))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` has one row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def update_from(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``new`` (one row per key) over those of ``old`` where they aren't null."""
    changed = [c for c in new.columns if c not in keys]
    joined = old.join(new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changed]), keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in old.columns])


def publish_once(df: DataFrame, path: str) -> None:
    """Write an artifact that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset on one machine."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="partwise-")
    return _own_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, for tables that several later steps use: plan and lineage end here."""
    path = f"{shared_folder(df.sparkSession)}/partwise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_once: dict[tuple, DataFrame] = {}


def stored_by(df: DataFrame, name: str, folder: str, order: list[str]) -> DataFrame:
    """Like ``stored``, one folder for each value of the column ``folder``, sorted within: readers skip by both."""
    path = f"{shared_folder(df.sparkSession)}/partwise/{name}-{uuid.uuid4().hex}"
    df.repartition(folder, F.pmod(F.xxhash64(*order), F.lit(8))).sortWithinPartitions(folder, *order).write.partitionBy(folder).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """``build()`` stored once for a session, folder and state of its tables, for results that many queries share.

    The state is the folder's own listing: names, sizes and times of change.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, sf_dir, name, state)
    if key not in _once:
        _once[key] = keep(build(), name)
    return _once[key]
