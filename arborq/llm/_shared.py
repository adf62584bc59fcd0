"""Helpers that several operators of this subpackage use: the shared folder, written
intermediate tables, size-checked semi joins, and bounds on the memory of Python passes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many ids are broadcast by :func:`restrict` (about 8 bytes each, 64 MB hashed); beyond it joins shuffle.
MAX_BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session. Where it is unset, a folder in the
    warehouse, which a cluster shares too; with a local master (as in tests) a temporary folder of the machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = tempfile.mkdtemp(prefix="arborq-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/arborq-work"
        spark.sparkContext.setCheckpointDir(folder)
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation of what stands before. The table is deleted by :func:`discard`, else
    when the session's JVM ends, since a result that is not read yet may rest on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arborq-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, folder = _file_system(spark, path)
    system.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/arborq-" in folder:
            system, path = _file_system(df.sparkSession, folder)
            system.delete(path, True)


#: A key with more rows than this is dealt over several tasks by :func:`spread`.
HOT_ROWS = 512


def hot_keys(sizes: DataFrame, key: str, n_col: str) -> DataFrame | None:
    """``(key, salts)`` of the keys of ``sizes(key, n)`` that hold over :data:`HOT_ROWS` rows, None if there are none; broadcast
    where their counted number is at most :data:`MAX_BROADCAST_IDS`."""
    salts = F.ceil(F.col(n_col) / HOT_ROWS).cast("int").alias("salts")
    hot = materialise(sizes.where(F.col(n_col) > HOT_ROWS).select(key, salts), "hot")
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= MAX_BROADCAST_IDS else hot


def spread(df: DataFrame, hot: DataFrame | None, key: str, by: str) -> DataFrame:
    """``df`` with ``salt``, from 0 up to the key's ``salts`` by a hash of ``by``; 0 for keys that aren't hot."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))
    return df.join(hot, key, "left").withColumn("salt", salt).drop("salts")


def replicate(per_key: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """The other side of a join with :func:`spread`: a hot key's row once for each ``salt``."""
    if hot is None:
        return per_key.withColumn("salt", F.lit(0))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    return per_key.join(hot, key, "left").withColumn("salt", salts).drop("salts")


def restrict(df: DataFrame, ids: DataFrame, n_ids: int, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``ids``. The ids are broadcast only when their
    counted number is at most :data:`MAX_BROADCAST_IDS`; else the join shuffles."""
    return df.join(F.broadcast(ids) if n_ids <= MAX_BROADCAST_IDS else ids, on, "left_semi")


def fold(doc_id, k: int):
    """crc32 of the id as text, modulo ``k``."""
    return F.crc32(doc_id.cast("string")) % k


#: Bytes of rows that go to a Python worker at a time (or one row).
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold about :data:`BATCH_BYTES` (a smaller bound that was set stays). Spark's own
    bound is 64 MB, and an executor keeps buffers of several times a batch outside its heap for each task."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_CONF))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """``run``, for mapInArrow; after each partition the worker gives freed memory back, since it stays for other tasks."""

    def passed(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return passed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
