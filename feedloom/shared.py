"""Session helpers that every job uses: the shared folder, written tables, checked broadcasts, shipping of this package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16_000_000
#: Bytes, about, of the batches that Spark hands to Python: long texts come a few at a time, not by thousands of rows.
ARROW_BATCH, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "feedloom-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends here, its size is known and no row is made twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.parquet(path)
    found._feedloom_path = path
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made, once nothing reads them any more."""
    for table in tables:
        remove(table.sparkSession, table._feedloom_path)


def _size(kind: T.DataType, value: Column) -> Column:
    """Bytes, about, of a value of a column."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(16), lambda total, x: total + _size(inner, x).cast("int")), F.lit(16))
        return 8 * F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_size(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if it has few enough rows and bytes, else as it is, for a shuffled join."""
    row = sum((_size(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(8)).cast("long")
    n, found = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and found <= size else df


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context, and bound the batches of this session in bytes."""
    context = spark.sparkContext
    if spark.conf.get(ARROW_BATCH, None) is None:
        spark.conf.set(ARROW_BATCH, str(ARROW_BYTES))
    if getattr(context, "_feedloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("feedloom", os.path.relpath(path, top)))
    path = os.path.join(tempfile.mkdtemp(prefix="feedloom-"), "feedloom_code.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    context.addPyFile(path)
    context._feedloom_shipped = True
