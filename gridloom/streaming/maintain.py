"""Counts kept current from streams of changes, with Structured Streaming.

An extension: what a batch computes over all changes, a stream keeps up to date.
Each micro-batch of element records becomes signed deltas against the records
known before it, which are added to the stored counts. Records and counts are
written as a new version, named by the batch, to any file system Spark writes;
a version counts once it is complete, so a batch that is run again after a
failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tags import process_tags
from ..operators.references import COUNTS, LATEST, add_deltas, change_deltas, latest_of, latest_records, newer_records, orphans, reference_deltas
from ..runtime import files, stored

#: Complete versions that are kept, for readers that still use the one before.
KEPT = 2


class Counts:
    """Versions of the known records and the counts in a folder that driver and
    executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        """Complete versions; counts are written last."""
        at = files(self.spark, f"{self.folder}/counts")
        return sorted(int(n[1:]) for n in at.names() if n[:1] == "v" and n[1:].isdigit() and at.has(f"{n}/_SUCCESS"))

    def _read(self, what: str, schema: str) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}/v{have[-1]}")

    def read(self) -> DataFrame:
        return self._read("counts", COUNTS)

    def records(self) -> DataFrame:
        return self._read("records", LATEST)

    def add(self, elements: DataFrame, batch: int, refs: DataFrame | None = None) -> None:
        """Adds the changes of element records, and further references."""
        have = self.versions()
        if have and batch <= have[-1]:
            return
        known = self.records()
        newer = stored(newer_records(latest_records(elements), known), "newer")
        deltas = [change_deltas(newer)] + ([reference_deltas(refs)] if refs is not None else [])
        latest_of(newer, known).write.mode("overwrite").parquet(f"{self.folder}/records/v{batch}")
        add_deltas(self.read(), *deltas).select("type", "id", "refs", "existence").write.mode("overwrite").parquet(f"{self.folder}/counts/v{batch}")
        for old in have[: 1 - KEPT]:
            for what in ("counts", "records"):
                files(self.spark, f"{self.folder}/{what}/v{old}").delete()

    def orphans(self) -> DataFrame:
        return orphans(self.read())


def maintain_references(elements: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps signed counts of a stream of element records."""
    counts = Counts(elements.sparkSession, folder)
    return elements.writeStream.foreachBatch(counts.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standard_tags(stream: DataFrame, **kw) -> DataFrame:
    """Tag standardisation on a stream; it keeps no state."""
    return process_tags(stream, **kw)


def windowed_edits(stream: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Edits per source and window of event time; later ones than ``late`` are
    dropped by the watermark."""
    return (
        stream.withWatermark("edited_at", late)
        .groupBy(F.window("edited_at", every), "source")
        .agg(F.count(F.lit(1)).alias("edits"))
        .select(F.col("window.start").alias("start"), "source", "edits")
    )
