"""Shared helpers: tables in the shared folder, skew-safe lookups."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a looked-up table may be broadcast; beyond it the lookup is a salted join.
BROADCAST_ROWS = 20_000

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs on one machine (tests) a
    temporary folder is made; a cluster without a shared folder is an error.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="partwise-")
    return _own_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/partwise/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    forget_path(spark, df.stored_at)


def forget_path(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, by position, so that no name of theirs can clash."""
    return F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def rows_again(packed: DataFrame, docs: DataFrame, row: str = "row") -> DataFrame:
    """The columns of ``docs`` from the structs that ``row_of`` made."""
    return packed.select(*[F.col(row).getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def with_results(packed: DataFrame, docs: DataFrame, results: dict[str, str], row: str = "row") -> DataFrame:
    """``docs`` columns, then ``results`` (name: column); a column of docs named like a result gives way to it."""
    own = [F.col(row).getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in results]
    return packed.select(*own, *[F.col(c).alias(name) for name, c in results.items()])


def packed_schema(packed: DataFrame, results: str) -> StructType:
    """The schema of ``row`` and some result columns, for Arrow functions that hand rows through."""
    return StructType([packed.schema["row"], *StructType.fromDDL(results).fields])


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps: it acts when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def lookup(big: DataFrame, small: DataFrame, on: list[str], salt: Column, salts: int = 16) -> DataFrame:
    """Left join of ``big`` with ``small`` (unique on ``on``; null keys equal null keys).

    ``small`` is counted first. Up to ``BROADCAST_ROWS`` rows it is broadcast;
    beyond that every row of it is repeated once per salt and the rows of a hot
    key of ``big`` spread over ``salts`` partitions. ``salt`` must tell apart
    the rows of one key and must not be random, so that retried tasks agree.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    right = small.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], *[c for c in small.columns if c not in on])
    same = None
    for c, k in zip(on, keys):
        one = big[c].eqNullSafe(F.col(k))
        same = one if same is None else same & one
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), same, "left").drop(*keys)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, same & (F.col("_salt") == F.col("_salt2")), "left").drop("_salt", "_salt2", *keys)


def salted_lookup(big: DataFrame, small: DataFrame, key: str, salt: Column, salts: int = 16, how: str = "left") -> DataFrame:
    """Equi-join of ``big`` with a table unique on ``key`` that is never broadcast."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_memories: dict[str, object] = {}


def remember_in(name: str, memory: object) -> None:
    """Make a worker process's memory (anything with ``clear``) known."""
    _memories[name] = memory


def use_memory(name: str) -> None:
    """Called at the start of a task: a reused worker keeps only the memory that this task's operator uses."""
    for other, memory in _memories.items():
        if other != name:
            memory.clear()
