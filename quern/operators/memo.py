"""Calls of a model that are made once for each distinct input, and kept.

Inputs that a kept table has are joined with it; of the others each distinct one is called once, in tasks,
and what succeeds is kept by a commit (``snapshots``).  A failure is null, and is tried again the next time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import SnapshotLog
from .store import written

_SCHEMA = "digest string, input string, output string"


class Memo:
    """Kept outputs in a folder.  ``load`` runs once a task and returns what turns an input into an output (null, or an exception: it failed)."""

    def __init__(self, spark: SparkSession, path: str, load: Callable[[], Callable[[str], str | None]]):
        self.spark, self.path, self.load = spark, path.rstrip("/"), load
        self.log = SnapshotLog(spark, path)

    def kept(self) -> DataFrame:
        """(digest, input, output) of all calls that succeeded."""
        commit = self.log.read()
        parts = [self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{p}") for p in commit["parts"]] if commit else [self.spark.createDataFrame([], _SCHEMA)]
        # two writers may have called for the same input
        return reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.min(F.struct("input", "output")).alias("x")).select("digest", "x.input", "x.output")

    def called(self, rows: DataFrame, column: str, result: str) -> DataFrame:
        """``rows`` with the output for ``column`` as ``result``; null for a null input and where the call failed."""
        digest = F.sha2(F.col(column), 256)
        wanted = rows.where(F.col(column).isNotNull()).select(digest.alias("digest"), F.col(column).alias("input")).groupBy("digest").agg(F.min("input").alias("input"))
        new = wanted.join(self.kept().select("digest"), "digest", "left_anti")
        load = self.load

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for batch in batches:
                out = []
                for text in batch.column(1).to_pylist():
                    model = model or load()
                    try:
                        out.append(model(text))
                    except Exception:  # one input's failure is its own
                        out.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["digest", "input", "output"])

        # written once: a call is not made again by whatever reads its output
        made = written(new.mapInArrow(run, _SCHEMA)).where("output is not null")
        if not made.isEmpty():
            made.write.parquet(folder := self.log.folder(self.log.latest() + 1))
            name = folder.rsplit("/", 1)[1]
            self.log.change(lambda _, commit: {"parts": [*(commit["parts"] if commit else []), name]})
        known = self.kept().select(F.col("digest").alias("_digest"), F.col("output").alias(result))
        return rows.join(known, digest == F.col("_digest"), "left").drop("_digest")


def translated(questions: DataFrame, memo: Memo, needed: str = "needs_translation", text: str = "clean") -> DataFrame:
    """``questions`` with ``translated`` and ``attempted``: what needs it is translated once a text; a failure leaves the question alone."""
    asked = questions.withColumn("_asked", F.when(F.col(needed), F.col(text)))
    return memo.called(asked, "_asked", "translated").withColumn("attempted", F.col("_asked").isNotNull()).drop("_asked")
