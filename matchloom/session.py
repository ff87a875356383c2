"""Session helpers: the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

BROADCAST_BYTES = 64 * 1024 * 1024
#: Spark's switch for deleting the shuffle files of a query as soon as it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own: executors on other machines would not
    see it.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="matchloom-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Parquet rather than ``checkpoint()``: later readers prune columns, and the
    optimizer knows the size. The shuffle files behind it go at once, not when the
    driver happens to collect its garbage: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/matchloom/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by ``cut_lineage``, once nothing reads them any more.

    A loop calls it on the state of a round after the next round is written.
    """
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A few driver rows as a local relation, whose size the optimizer knows."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [[] for _ in fields]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    data = [pa.array(list(c), type=t) for c, t in zip(columns, arrow.types)]
    return spark.createDataFrame(pa.Table.from_arrays(data, schema=arrow), fields)


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, text counted by length, stay within ``max_bytes``."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns),
        F.lit(16),
    )
    return (df.agg(F.sum(width)).first()[0] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size is within ``max_bytes``.

    Anything larger is returned unhinted, and the join stays a shuffle join
    that adaptive execution can split on skewed keys.
    """
    return F.broadcast(df) if fits(df, max_bytes) else df
