"""From raw documents to token ids: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and read again as the
documents of the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventspark.llm import compression_quality, gray_simhash, prefix_viterbi, pu_toxicity, source_mixing
from eventspark.llm.common import shipped, table
from eventspark.llm.queries import tokenizer_path
from eventspark.scratch import store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts have no toxic word and stay; repeated rows go or stay together; rows without an id are
    judged like others; an empty table stays empty. All columns pass unchanged, whatever their names.
    """
    return pu_toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of quality go.

    Null and empty texts all get the calibrated score of no difference; repeated rows go or stay together; an
    empty table stays empty. All columns pass unchanged, whatever their names.
    """
    return compression_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Null and empty texts are one group; of repeated rows of an id one stays; rows without an id stay only if
    their group has no id, one of them; an empty table stays empty. Columns pass unchanged, whatever their names.
    """
    return gray_simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their sources take them; the last one of a source in part.

    A null source is a source, the last. Null and empty texts have no words and are never taken. Rows that
    repeat an id are taken by a hash of their text. An empty table stays empty. ``text`` and ``n_chars`` of a document
    taken in part are cut; other columns pass unchanged, whatever their names.
    """
    return source_mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids, same) of every row: its text as token ids, decoded again and compared.

    Null and empty texts have no ids; repeated rows and rows without an id are encoded like others; an empty
    table gives none. Other columns end here.
    """
    return prefix_viterbi.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [(name, shipped(stage)) for name, stage in (
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
)]

#: The classifiers, fingerprints and merges have no SQL form; tests compare each stage with a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the rows go through the shared folder.

    Each stage's docstring says what becomes of nulls, empty texts, repeated rows and empty tables.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
