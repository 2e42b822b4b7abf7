"""ST7: rows behind the watermark are routed to a side table instead of vanishing.

``split_late`` keeps its own watermark, by Spark's rule (the greatest event time of all earlier micro-batches, less the delay), as
one small row a micro-batch in the checkpoint folder. A micro-batch is split against the mark of the batches before it: on-time rows go
to the main table, late ones to the side table with the watermark they missed. Both are written under the
micro-batch's own folder, so a batch that is run again after a failure replaces what it wrote, against the same mark.
What a later stateful job with the same delay would drop without a trace is exactly the side table; together they are the batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

from millrun.sources.io import write_table
from millrun.streaming.jobs import _scratch, file_stream


class Landing:
    """A folder that receives a table's rows in the order of arrival, one arrival slice after the other.

    The rows are staged once, a folder for each value of ``arrival`` (whole numbers, few: one run of the stream each).
    """

    def __init__(self, rows: DataFrame, arrival: str, name: str):
        self.spark = rows.sparkSession
        base = _scratch(self.spark, f"landing-{name}")
        self.staged, self.path = os.path.join(base, "staged"), os.path.join(base, "landed")
        self.schema = rows.drop(arrival).schema
        write_table(rows.withColumnRenamed(arrival, "arrival"), self.staged, by=("arrival",))
        self.slices = sorted(r[0] for r in rows.select(arrival).distinct().collect())
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)

    def land(self, piece: int) -> None:
        rows = self.spark.read.schema(self.schema).parquet(os.path.join(self.staged, f"arrival={piece}"))
        rows.write.mode("append").parquet(self.path)

    def stream(self, max_files_per_trigger: int | None = None) -> DataFrame:
        return file_stream(self.spark, self.schema, self.path, max_files_per_trigger)


class LateSplit:
    """Where a split writes: ``rows`` (with ``is_late`` and ``watermark``) and ``marks``, a folder for each micro-batch."""

    def __init__(self, stream: DataFrame, name: str, ts: str, delay: str):
        self.spark, self.stream, self.ts, self.delay = stream.sparkSession, stream, ts, delay
        base = _scratch(self.spark, f"late-{name}")
        self.rows, self.marks, self.checkpoint = (os.path.join(base, x) for x in ("rows", "marks", "checkpoint"))
        fields = StructType([*stream.schema.fields, StructField("watermark", TimestampType())])
        self.spark.createDataFrame([], fields).write.parquet(os.path.join(self.rows, "_batch=-1", "is_late=false"))
        self.schema = StructType([*fields, StructField("_batch", LongType()), StructField("is_late", BooleanType())])

    def mark_before(self, batch_id: int):
        """Greatest event time of the earlier micro-batches (None for the first)."""
        if batch_id == 0:
            return None
        marks = self.spark.read.schema("newest timestamp, _batch bigint").parquet(self.marks)
        return marks.where(F.col("_batch") < batch_id).agg(F.max("newest")).first()[0]

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        seen = self.mark_before(batch_id)
        watermark = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        rows = batch.withColumn("watermark", watermark)
        rows = rows.withColumn("is_late", F.coalesce(F.col(self.ts) < F.col("watermark"), F.lit(False)))
        rows.write.mode("overwrite").partitionBy("is_late").parquet(os.path.join(self.rows, f"_batch={batch_id}"))
        newest = batch.agg(F.max(self.ts).cast("timestamp").alias("newest"))
        newest.write.mode("overwrite").parquet(os.path.join(self.marks, f"_batch={batch_id}"))

    def run(self) -> None:
        """All that has landed since the last run, from the same checkpoint."""
        query = self.stream.writeStream.foreachBatch(self.sink).option("checkpointLocation", self.checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """``(main, late)``; the side table has the watermark that a row missed and the micro-batch that brought it."""
        rows = self.spark.read.schema(self.schema).parquet(self.rows)
        main = rows.where(~F.col("is_late")).drop("watermark", "_batch", "is_late")
        return main, rows.where("is_late").drop("is_late")


def split_late(landing: Landing, ts: str, delay: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Land slice after slice, a run of the stream (restarted from its checkpoint) after each; ``(main, late)`` of it all.

    A null event time is never late. Equal rows are judged alike. Without rows both tables are empty.
    """
    split = LateSplit(landing.stream(), name, ts, delay)
    for piece in landing.slices:
        landing.land(piece)
        split.run()
    return split.tables()


def reconciled(main: DataFrame, late: DataFrame, batch: DataFrame, by: list) -> DataFrame:
    """Rows of the main and the side table against the batch, by group; ``missing`` is 0 where nothing was lost."""
    counts = [
        d.select(*by, F.lit(int(i == 0)).alias("m"), F.lit(int(i == 1)).alias("s"), F.lit(int(i == 2)).alias("b"))
        for i, d in enumerate((main, late, batch))
    ]
    both = counts[0].unionByName(counts[1]).unionByName(counts[2])
    keys = both.columns[: len(by)]
    return both.groupBy(*keys).agg(
        F.sum("m").alias("on_time_rows"), F.sum("s").alias("late_rows"), F.sum("b").alias("batch_rows"), F.sum(F.col("b") - F.col("m") - F.col("s")).alias("missing")
    )
