"""Scoring of reports as they arrive.

Everything that looks at one row at a time (cleaning, ratings, sentiment, tone, cohesion, ranks by kept
quantiles) runs unchanged on a stream: no state, no watermark, and a batch that is run again gives the
same rows. Fits need all rows and stay with batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkwell.functions.profiles import Profile
from inkwell.operators import sentiment


def read_reports(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def sentiment_stream(reports: DataFrame, p: Profile, caliber: str = "raw") -> DataFrame:
    return sentiment.scores(sentiment.counts(reports, p), caliber)


def start(scored: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scores to a Parquet folder, each batch exactly once."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(folder)
