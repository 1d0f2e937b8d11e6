"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest relation, in bytes, that an operator hands to every executor.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of an Arrow batch, where the session names none.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

#: Makes Spark delete the shuffle files of an execution when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Where ``materialize`` wrote a table.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="readlake-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    With ``tidy`` the shuffle files of the write go as soon as the table is whole; the session's own setting is put back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    own = spark.conf.get(CLEANUP, None)
    try:
        if tidy:
            spark.conf.set(CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if own is None else spark.conf.set(CLEANUP, own)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and that no later plan reads."""
    for df in tables:
        if df is not None and (path := _written.pop(df, None)):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no column has, whatever its case."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, given only where a count shows that ``df`` is below ``limit``.

    Beyond it the plain join stays, which adaptive execution splits where a key is skewed.
    ``df`` should be a materialised table, as it is counted here.
    """
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def salted_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: list[str], hot: int = 1000) -> DataFrame:
    """``left`` joined (left outer) to ``right``, which is unique by ``key`` and whose ``weight`` says
    how many rows of ``left`` have a key.

    A key that holds over 1 / ``hot`` of the rows, of which there are at most ``hot``, is dealt to
    several tasks in proportion: its row of ``right`` is repeated, and its rows of ``left`` pick one
    by a hash of ``spread``. So a key with a third of all rows overloads no task."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    k, n, salt, other = free_names([*left.columns, *right.columns], "_k", "_n", "_salt", "_other")
    own = right.drop(weight).withColumnRenamed(key, k)
    some = right.filter(F.col(weight) * hot > total).select(F.col(key).alias(k), F.ceil(F.col(weight) * hot / total).cast("int").alias(n)) if total else None
    if some is None or not some.limit(1).count():
        return left.join(own, left[key] == own[k], "left").drop(k)
    some = materialize(some, "hot-keys")
    own = own.join(F.broadcast(some), k, "left").withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))).drop(n)
    dealt = left.join(F.broadcast(some), F.col(key) == F.col(k), "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*spread), F.col(n)).cast("int"), F.lit(0))).drop(k, n)
    return dealt.join(own, (F.col(key) == F.col(k)) & (F.col(salt) == F.col(other)), "left").drop(k, salt, other)


def with_uid(df: DataFrame) -> DataFrame:
    """Row identity, so that null or repeated doc_ids stay apart."""
    return df.withColumn("_uid", F.monotonically_increasing_id())


def release() -> None:
    """Gives memory that a reused Python worker no longer needs back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches from Spark's default of 10,000 rows: texts are long, and
    buffers of large batches stay with executors. Values that a session has set are kept."""
    for key, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(own))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, rows: int = 1 << 30) -> DataFrame:
    """``mapInArrow`` with a function of one batch, of at most ``rows`` rows."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
                del out
            release()

    return df.mapInArrow(run, schema)


def reduce_arrays(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, dtype: str, add: np.ufunc, parts: int = 16) -> np.ndarray:
    """One array of ``size`` (a multiple of ``parts``) that all partitions fill, added up by ``add``.

    Each task sends its array in slices, and each slice is added up by a task of its own, so no
    task and no driver reads more than a slice from each task, or one array in all."""
    small_batches(df.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codec = np.zeros(size, dtype), pa.Codec("zstd", 1)
        for batch in batches:
            fill(own, batch)
        cut = own.reshape(parts, -1)
        some = [i for i in range(parts) if cut[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([codec.compress(cut[i].tobytes(), asbytes=True) for i in some], pa.binary())], names=["part", "data"])
        del own, cut
        release()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sums = pa.Codec("zstd"), {}
        raw = size // parts * np.dtype(dtype).itemsize
        for batch in batches:
            for i, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(codec.decompress(data, raw, asbytes=True), dtype)
                sums[i] = add(sums[i], x) if i in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([codec.compress(x.tobytes(), asbytes=True) for x in sums.values()], pa.binary())], names=["part", "data"])
        release()

    kinds = "part int, data binary"
    out = np.zeros((parts, size // parts), dtype)
    for r in df.mapInArrow(build, kinds).repartitionById(parts, F.col("part")).mapInArrow(join, kinds).collect():
        out[r.part] = add(out[r.part], np.frombuffer(pa.Codec("zstd").decompress(r.data, out[0].nbytes, asbytes=True), dtype))
    return out.ravel()
