"""A corpus cleaned in five stages, each a call of one document operator.

A stage takes (spark, docs, sf_dir) and gives the documents it keeps; each result is
written and read again before the next stage. The last stage gives token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, nbsvm, simhash, spaced, surrogates
from loomgraph.llm.common import cut, table

#: Score under which the quality stage rejects a document.
QUALITY = 0.7
#: Near copies: words of a shingle, and similarity of the sets of shingles at least.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches `QUALITY`, by a model of the labelled ones.

    The score is computed where the row lies, so null and repeated ids make no difference; a null
    text is scored as an empty one, a very long one whole. Without usable labels all scores are
    0.5, and nothing is kept. Other columns are carried through, whatever their names."""
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    return nbsvm.keep(docs, model, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Empty texts (null ones, too) are copies of each other. Rows without an id stay; of rows that
    repeat an id one stays. Very long texts count whole, an empty table stays empty."""
    return simhash.keep_similar(docs, shingle=SHINGLE, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark; null and empty texts share none, repeated
    rows go or stay together, and without a benchmark all stay."""
    return spaced.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars is counted anew (null for a null
    text). Repeated texts are replaced alike, columns of any other name are carried through."""
    return surrogates.replace(docs, counted=None).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every document; a null or empty text has no ids,
    repeated rows repeat their result, very long texts are encoded whole, no rows give none."""
    encoded = bpe.encode(docs, decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("bpe encoding and decoding", tokens),
]

#: Fingerprints, models and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; all but the last are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
