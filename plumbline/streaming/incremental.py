"""The append log as a stream: running label counts, from which all count-based statistics follow at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import stats
from ..sources.readers import RESPONSE


def source(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).json(path)


def label_counts(samples: DataFrame) -> DataFrame:
    """Running counts of interface and storage classes by prompt and model; state grows with labels, not with samples."""
    code = tx.extract_code(F.col("response_text"))
    s = samples.select("prompt_id", "model_display", code.alias("code")).withColumn("imports", tx.import_names(F.col("code")))
    label = F.concat_ws("|", tx.storage(F.col("code"), F.col("imports")), tx.interface(F.col("code")))
    return s.groupBy("prompt_id", "model_display", label.alias("label")).agg(F.count("*").alias("c"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and means by event type in tumbling windows; state of windows past the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def watermarked(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with the promise that none comes later than `late` after one of a later time; those that do are dropped. Batches are as they are."""
    return events.withWatermark("ts", late) if events.isStreaming else events


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event of a watermarked stream once: copies that come within the watermark of the first are dropped. State holds a key until then.

    In a batch every copy is dropped, whatever its distance. Which of the copies stays is not defined, so copies should be equal.
    """
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """user, start, last, n, total of each run of a user's events in which none is later than gap after the one before.

    Two events exactly gap apart are of one session. State is one row an open session; a session is emitted (append) once
    the watermark has passed its end, so a stream needs one (`watermarked`). Events without a time belong to no
    session; those without a user are one user's.
    """
    g = events.groupBy(F.session_window("ts", gap).alias("w"), user)
    return g.agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.sum("value").alias("total")).select(user, F.col("w.start").alias("start"), "last", "n", "total")


def start_append(df: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Closed windows or sessions as Parquet, each written exactly once; without `every` it takes what is there and ends."""
    w = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def start(counts: DataFrame, name: str, checkpoint: str):
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def diversity_now(counts: DataFrame) -> DataFrame:
    """Statistics of the counts as they stand."""
    return stats.diversity(counts, ["prompt_id"])
