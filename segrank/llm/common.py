"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that a Python step handles at once; it bounds a worker's memory whatever the Arrow batch holds.
CHUNK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, a local master gets a folder of its own; a cluster
    raises, as a machine-local folder would not be seen by the other machines."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here and no lost executor undoes it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes tables that :func:`stored` wrote, once all that reads them has been written itself."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as rows, so that very long texts do not make very large batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_chunks(batches: Iterator[pa.RecordBatch], key: str, text: str,
                limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts as UTF-8 bytes (null: empty), in groups of about ``limit`` bytes; a longer text is a group."""
    keys: list = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        col = b.column(text)
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
        for k, t in zip(b.column(key).to_pylist(), col.to_pylist()):
            t = t or b""
            if texts and size + len(t) > limit:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(k)
            texts.append(t)
            size += len(t)
    if texts:
        yield keys, texts


def id_fold(column: str = "doc_id", folds: int = 4):
    """crc32 of the id as text, modulo ``folds``; null ids give fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)), F.lit(0))
