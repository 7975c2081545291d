"""Resumable ingest of new files and the current state of a label log, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.operators.labels import latest
from glyphmill.operators.lineage import cut


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Append the rows of files not seen before to ``target`` and stop; the checkpoint remembers what was taken."""
    rows = spark.readStream.format(fmt).schema(schema).load(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_latest(stream: DataFrame, key: str, ordinal: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row per key of a log in ``target``: each micro-batch is folded into the next generation of the table.

    Late marks lose against later ones by ``ordinal``. Generations alternate between two folders so a failed batch can
    be repeated from the one before.
    """
    spark = stream.sparkSession

    def exists(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def fold(batch: DataFrame, n: int) -> None:
        new = latest(batch, key, ordinal)
        before = f"{target}/{(n - 1) % 2}"
        if exists(before):
            new = latest(spark.read.schema(batch.schema).parquet(before).unionByName(new), key, ordinal)
        elif n:
            raise FileNotFoundError(f"{before} is gone, but batch {n} builds on it")
        elif exists(f"{target}/{n % 2}"):  # a new checkpoint over an existing table goes on from it
            new = cut(latest(spark.read.schema(batch.schema).parquet(f"{target}/{n % 2}").unionByName(new), key, ordinal))
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/{n % 2}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts per window and kind with a watermark; works on streams and tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
