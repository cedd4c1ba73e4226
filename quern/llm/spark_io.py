"""Small Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows and bytes (as JSON) may be broadcast; beyond either joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows; one that Spark reads in a task or two, as small files are, is dealt to all cores first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and rows.rdd.getNumPartitions() * 3 <= cores:
        return rows.repartition(cores)
    return rows


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, a local session gets a temporary folder; a cluster has no folder
    that could be taken for shared, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            root = set_dir.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="spark-quern-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root}/quern-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a short lineage that outlives executors.

    A result may be read long after the operator returned, so its tables stay; whoever owns the
    checkpoint folder clears it, as with Spark's own checkpoints.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has at most ``rows`` rows of at most ``size`` bytes together.

    Beyond the bounds the table is returned as it is, and the join shuffles.
    """
    if df.count() > rows:
        return df
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if held <= size else df


def absent(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
