"""Row-wise operators on a stream of event lines.

Parsing, selection and encoding look at one event at a time, so they run unchanged on a streaming
table. What needs a global order (packing, splitting over sequence edges) stays in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.operators.encoding import encode_events, pad_sequences
from eventspark.operators.vocabulary import Vocabulary
from eventspark.sources.text import parse_event_lines


def event_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Event files as they arrive in a folder -> (file, particles)."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(folder).select("value", F.col("_metadata.file_name").alias("file"))
    return parse_event_lines(lines)


def encoded_stream(events: DataFrame, vocab: Vocabulary, length: int) -> DataFrame:
    """Valid events as padded sequences; the length is fixed beforehand, a stream has no maximum."""
    return pad_sequences(encode_events(events, vocab), length, vocab)
