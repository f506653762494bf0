"""What the corpus operators share: reading, words, intermediate tables and exchanges of sorted keys.

Conventions that hold for every operator here:

* Only the columns an operator names are read; further columns, whatever they are called, are ignored.
* Rows whose id is null cannot be addressed by a result and are left out.
* A null text counts as an empty one unless the operator says otherwise.
* Intermediate tables are Parquet files in the shared folder named by ``spark.checkpoint.dir``. Without that setting a
  folder of this machine is used if the master is local; on a cluster it is an error. They go when the driver ends.
* Two limits of Arrow batches are set in the session of the documents (``tune``) and stay set, as results are lazy.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U64 = np.uint64
_made: list[tuple[SparkSession, str]] = []


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches limited by bytes as well as rows, so that long texts do not gather in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns of the rows that have an id."""
    tune(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def words(text: str) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(LOWER).split()


def id_crc(doc_id: int) -> int:
    return zlib.crc32(b"%d" % doc_id)


def id_crc_column(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="melisma-")
        shared_dir.own = base
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder. Shuffle files of the job that made it go at once."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/melisma/{name}-{uuid.uuid4().hex}", spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    finally:
        spark.conf.set(key, before)
    _made.append((spark, path))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # also if the session is stopped
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    for spark, path in list(_made):
        if any(path in f for f in df.inputFiles()[:1]):
            _delete(spark, path)
            _made.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def size_of(df: DataFrame) -> int:
    """Bytes of the input files by the optimiser's statistics; counted where these are unknown."""
    got = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if got < 1 << 50:
        return got
    return df.select(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(docs: DataFrame, each: int = 4 << 20) -> int:
    """How many key ranges an exchange gets: in proportion to the input, so that a range stays of one size."""
    return max(16, -(-size_of(docs) // each))


def cut(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and bounds of the non-empty ones of ``n`` equal key ranges in sorted unsigned keys."""
    at = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(U64) if n > 1 else np.zeros(0, U64)
    edges = np.concatenate([[0], np.searchsorted(keys, at), [len(keys)]]).astype(np.int64)
    full = np.nonzero(edges[1:] > edges[:-1])[0]
    return full, edges


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def blobs(column: pa.ChunkedArray | pa.Array, kind) -> list[np.ndarray]:
    """Binary values as arrays without copying."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for c in chunks for x in c]


def planes(a: np.ndarray) -> bytes:
    """An array's bytes with those of equal significance together: what is sorted, small or zero compresses."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def rows_of(batches: Iterator[pa.RecordBatch], *names: str):
    """The rows of Arrow batches as tuples."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


class Out:
    """Gathers output rows into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 4000, size: int = 2 << 20):
        self.schema, self.rows, self.size = schema, rows, size
        self.clear()

    def clear(self) -> None:
        self.held: list[list] = [[] for _ in self.schema]
        self.bytes = 0

    def add(self, *row) -> None:
        for c, v in zip(self.held, row, strict=True):
            c.append(v)
            if isinstance(v, bytes | str):
                self.bytes += len(v)

    def full(self) -> bool:
        return len(self.held[0]) >= self.rows or self.bytes >= self.size

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.held, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return out
