"""The chunk store: deterministic ids, keyed upsert, replacement by source, versioned tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from .snapshots import SnapshotLog


def shared_folder(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; where the session has none, a local one gets a temporary folder, and on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            root = known.get()
        elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="spark-quern-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root}/quern-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: int) -> DataFrame:
    """``df`` as a table in the shared folder; ``options`` are those of the writer."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of at most so many rows and bytes (as JSON) may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def small_or_not(df: DataFrame) -> DataFrame:
    """``df`` (a written table) marked for broadcast if its rows and bytes are counted to be few; beyond that the join shuffles."""
    if df.count() > BROADCAST_ROWS:
        return df
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def with_ids(chunks: DataFrame, position: str = "chunk_index") -> DataFrame:
    """``chunks`` with ``chunk_id``, of the source, the place among all its chunks, and the text."""
    return chunks.withColumn("chunk_id", chunk_id(F.col("source"), F.col(position), F.col("text")))


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same key; of a key's several new rows the least stays."""
    order = Window.partitionBy(key).orderBy(*[c for c in sorted(new.columns) if c != key])
    latest = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return existing.join(latest.select(key), key, "left_anti").unionByName(latest)


def delete_by_source(existing: DataFrame, source: str) -> DataFrame:
    """Rows without a source stay."""
    return existing.where(~F.col("source").eqNullSafe(F.lit(source)))


def replace_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` with every source that ``new`` has rows of replaced by them; sources without new rows keep their old ones."""
    return existing.join(new.select("source").distinct(), "source", "left_anti").unionByName(new, allowMissingColumns=True)


def ingest_report(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: chunks in all, sources with chunks, and the names of those without, in order."""
    per = sources.select("source").distinct().join(chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.count("n").alias("sources_ok"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("n").isNull(), F.col("source")))), ",").alias("failures"),
    )


class ChunkTable:
    """Versions of a chunk table in a folder, by a log of commits (``snapshots``).

    Readers see a version until the next is whole, unlike delete-then-insert.  ``replace``, ``upsert`` and ``delete``
    are done again on the newer version if another writer commits first, so no writer's rows are lost.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = SnapshotLog(spark, path)

    def current(self, number: int | None = None) -> DataFrame | None:
        """The last version, or that of a commit; None if nothing was ever committed."""
        commit = self.log.read(number)
        return None if commit is None else self._rows(commit)

    def _rows(self, commit: dict) -> DataFrame:
        return self.spark.read.schema(commit["schema"]).parquet(f"{self.path}/{commit['data']}")

    def history(self) -> list[dict]:
        """All commits, the first one first."""
        return [self.log.read(n) for n in range(1, self.log.latest() + 1)]

    def _change(self, operation: str, make: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
        def write(at: int, commit: dict | None) -> dict:
            rows = make(None if commit is None else self._rows(commit))
            folder = self.log.folder(at + 1)
            rows.repartition("source").sortWithinPartitions("source").write.parquet(folder)
            return {"data": folder.rsplit("/", 1)[1], "operation": operation, "schema": _ddl(rows)}

        return self._rows(self.log.change(write))

    def ensure(self, schema: str) -> DataFrame:
        """The current version, or an empty first one with these columns."""
        old = self.current()
        return self._change("ensure", lambda now: self.spark.createDataFrame([], schema) if now is None else now) if old is None else old

    def publish(self, rows: DataFrame) -> DataFrame:
        """``rows`` in place of whatever is there."""
        return self._change("publish", lambda _: rows)

    def replace(self, new: DataFrame) -> DataFrame:
        return self._change("replace", lambda old: new if old is None else replace_sources(old, new))

    def upsert(self, new: DataFrame, key: str = "chunk_id") -> DataFrame:
        return self._change("upsert", lambda old: new if old is None else upsert(old, new, key))

    def delete(self, source: str) -> DataFrame:
        """Without a source; a table that was never written stays so."""
        if self.current() is None:
            raise ValueError(f"{self.path} has no version")
        return self._change("delete", lambda old: delete_by_source(old, source))


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
