"""The stateful behaviours as Structured Streaming jobs: limits per window, duplicates, incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.feedback import normal_action
from ..operators.ingest import envelope_status


def requests_per_window(requests: DataFrame, limit: int, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """(client, window_start, n, refused) of a stream (client, ts): counts in fixed windows, late rows up to ``late``."""
    w = F.window("ts", f"{seconds} seconds")
    counts = requests.withWatermark("ts", late).groupBy("client", w).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("client", F.col("window.start").alias("window_start"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("refused"))


def first_feedback(feedback: DataFrame, within: str = "1 day") -> DataFrame:
    """The first row of each (recipe, fingerprint, action) within the time that state is kept."""
    rows = feedback.withColumn("action", normal_action()).withWatermark("created_at", within)
    return rows.dropDuplicatesWithinWatermark(["recipe_id", "client_fingerprint", "action"])


def ingest_envelopes(bodies: DataFrame, checkpoint: str, target: str, rejected: str):
    """A started query that splits arriving envelopes (envelope_id, body) into valid and rejected ones, exactly once."""

    def batch(df: DataFrame, number: int) -> None:
        judged = df.join(envelope_status(df), "envelope_id")
        judged.where("status = 'valid'").select("envelope_id", "body").write.mode("overwrite").parquet(f"{target}/batch={number}")
        judged.where("status = 'invalid'").select("envelope_id", "reason").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return bodies.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
