"""Token files decoded as they grow.

The source counts records, so its offset is the number of whole records that a folder holds; parts are
appended, or further parts added behind the last in name order. What a batch writes lies in a folder of
its own that a repeated batch replaces, so after a restart nothing is lost and nothing is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventspark.operators.tokenizers import ParticleTokenizer
from eventspark.sources import token_files


def token_stream(spark: SparkSession, metadata_path: str, root: str | None = None) -> DataFrame:
    """(seq_id, tokens) of a token file that still grows; type and length come from its metadata, totals do not count."""
    token_files.register(spark)
    reader = spark.readStream.format(token_files.FORMAT).option("path", metadata_path).option("growing", True)
    return (reader.option("root", root) if root else reader).load()


def decode_stream(sequences: DataFrame, tokenizer: ParticleTokenizer, pdg: DataFrame, output: str, checkpoint: str,
                  available_now: bool = False) -> StreamingQuery:
    """Write each batch's particles below ``output``/particles and its rejected events below ``output``/rejects.

    ``tokenizer`` has to decode row by row. With ``available_now`` the query ends with what is there.
    """
    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # read for both outputs
        try:
            particles, rejected = tokenizer.decode(kept, pdg)
            particles.write.mode("overwrite").parquet(f"{output}/particles/batch={number}")
            rejected.write.mode("overwrite").parquet(f"{output}/rejects/batch={number}")
        finally:
            kept.unpersist()

    writer = sequences.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
