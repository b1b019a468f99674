"""What the operators of this subpackage share: tables, the shared folder, packed shuffles."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contracts: space, and 0x09 to 0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> None:
    """Batches that go to Python hold so many bytes at most, and not only a number of rows, which may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; a temporary
    one only where the session names none (local tests)."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = sys.__dict__.setdefault("_skein_shared", {})
        path = held.setdefault(spark.sparkContext.applicationId, None)
        if path is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = held[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="skein-")
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and reread it: cuts the lineage, outlives executors.

    by: a string column whose values are kept in files of their own.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._skein_path = path
    made(spark).append(path)
    return back


def made(spark: SparkSession) -> list[str]:
    """Paths of the tables that this session has stashed and not deleted, in order."""
    return sys.__dict__.setdefault("_skein_made", {}).setdefault(spark.sparkContext.applicationId, [])


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        path, spark = getattr(df, "_skein_path", None), df.sparkSession
        if path:
            delete(spark, path)
            if path in made(spark):
                made(spark).remove(path)


def forget_since(spark: SparkSession, before: int) -> None:
    """Delete the tables stashed after the first so many: a result that needed them is written."""
    while len(made(spark)) > before:
        delete(spark, made(spark).pop())


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's
    memory is collected, which on a large heap is long after."""
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame, name: str, before: int) -> DataFrame:
    """A small result, stashed, without the tables it needed that were stashed after the first so many."""
    back = stash(df, name)
    made(df.sparkSession).remove(back._skein_path)
    forget_since(df.sparkSession, before)
    made(df.sparkSession).append(back._skein_path)
    return back


def kept(name: str, make: Callable):
    """A value that a Python worker keeps between tasks, made on first use.

    Only the last one stays, so that workers don't gather the caches of all steps they have run.
    """
    held = sys.__dict__.setdefault("_skein_kept", {})
    if name not in held:
        held.clear()
        give_back()
        held[name] = make()
    return held[name]


def give_back() -> None:
    """Return a worker's freed memory to the system, where its C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about so many bytes, one row at least."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def held_out(doc_id: Column, parts: int) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by parts."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 2, F.lit(False))


def batches(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split() for x in ddl.split(","))])


def texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch; null reads as empty."""
    return ("" if x is None else x for x in batch.column(column).to_pylist())


def free_names(names: tuple[str, ...], taken: list[str]) -> list[str]:
    """The names, each with underscores behind it until no column has it."""
    held = {x.lower() for x in taken}
    return [next(y for k in range(len(held) + 1) if (y := x + "_" * k).lower() not in held) for x in names]
