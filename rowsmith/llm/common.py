"""What the training-data operators share: tables, shared storage and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space that separates words: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new URI below spark.checkpoint.dir, which driver and executors share.

    A folder without a scheme is one of the cluster's default file system, as it is to Spark itself.  Where the
    setting is unset, one machine (tests) uses a temporary folder, removed at exit; a cluster is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = spark.conf.get("spark.rowsmith.shared.dir", None)
    if not base:
        own = tempfile.mkdtemp(prefix="rowsmith-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.rowsmith.shared.dir", base)
    path = context._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/rowsmith/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nothing reads the mark
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    if _HELD:
        _HELD[-1].append(found)
    return found


#: Frames settled within the scratch() blocks that are open, innermost last.
_HELD: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What is settled in this block is deleted at its end, but for the frames put into the list it gives."""
    keep: list[DataFrame] = []
    _HELD.append([])
    try:
        yield keep
    finally:
        discard(spark, *[df for df in _HELD.pop() if not any(df is k for k in keep)])
        for outer in _HELD[-1:]:
            outer += keep


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files below settled frames that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer reachable."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; works on executors too (file, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def commit_file(uri: str, write: Callable[[pa.NativeFile], None]) -> int:
    """Write a file under another name, then move it into place, so that a retried or doubled task is harmless."""
    disk, path = store(uri)
    disk.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with disk.open_output_stream(own) as out:
        write(out)
        size = out.tell()
    disk.move(own, path)
    return size


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, limit: int | None = None) -> DataFrame:
    """mapInArrow over one batch at a time, in batches that stay small when texts are long.

    limit: about so many bytes of the column `text` at once, but for one longer text.
    """
    bounded(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit) if limit else [batch]:
                if part.num_rows:
                    yield fn(part)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of text."""
    sizes = pc.fill_null(pc.binary_length(column(batch, "text")), 0).to_numpy(zero_copy_only=False)
    lo = size = 0
    for k, n in enumerate(sizes):
        if size and size + n > limit:
            yield batch.slice(lo, k - lo)
            lo, size = k, 0
        size += int(n)
    yield batch.slice(lo)


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_only(df: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads; others, whatever their names, do not reach it."""
    return df.select(*columns)


def bucket(name: str, modulus: int) -> F.Column:
    """crc32 of a column's text modulo a number: the folds of the labelled operators."""
    return F.crc32(F.col(name).cast("string")) % F.lit(modulus)
