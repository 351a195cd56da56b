"""A pipeline over ``documents``: language, exact copies, near copies, the mix of sources, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``documents``; each stage's result is written as Parquet in the
shared folder and read again, so that a lost executor costs at most the running stage. Tables that
the next stage doesn't read are deleted, the result stays.

Defined cases, by stage. Documents without a letter (null and empty texts among them) go in
``language_id``, whatever their other columns hold; a null ``lang`` trains nothing; no stage drops a
document for its length, a null id, source or ``n_chars``. ``exact_dedup`` keeps of equal texts the
row with the smallest id, null last, and one of the rows that repeat it. ``near_dedup`` decides by row: of a component
the row with the smallest id stays, null last, ties by a hash of id and text; rows without ids and rows
that share one are told apart by their texts. ``source_mix`` takes a null source as one source, the
last, and repeats rows up to three times. ``packing`` loses no token, and spreads rows without ids like others. An
empty table, or one without a learned language, gives an empty result. ``documents`` may have more
columns, of any name: they are passed on up to ``packing``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmend.llm import langid
from lexmend.llm.common import crc_bucket, delete, row_keyed, scratch
from lexmend.llm.exact_dedup import drop_exact_copies
from lexmend.llm.mixing import mix
from lexmend.llm.packing import pack
from lexmend.llm.simhash import drop_near_copies
from lexmend.llm.tokens import token_counts
from lexmend.plans.home import shared_dir

#: Texts whose n-grams are further than this from typical ones, in deviations, are in no known language.
LEAST_FIT = -10.0
#: Near copies share this much of their sets of five-word shingles; by one of two fingerprints nearly all are within the distance.
NEAR_WORDS, NEAR_SIMILARITY, NEAR_DISTANCE = 5, 0.8, 14


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter, and those no language fits, go."""
    model = langid.fit(langid.training_rows(docs, crc_bucket(F.col("doc_id")) == 0))
    return langid.keep_known(docs, model, least_fit=LEAST_FIT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with similar shingle sets, that with the smallest id."""
    return drop_near_copies(docs, distance=NEAR_DISTANCE, n=NEAR_WORDS, least_similarity=NEAR_SIMILARITY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in length buckets of least padding."""
    keyed, key = row_keyed(docs)
    return pack(token_counts(keyed, also=(key,)), F.col("tokens"), row_col=key)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Training a classifier and choosing buckets are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home, written = f"{shared_dir(spark)}/lexmend/pipeline-{uuid.uuid4().hex}", []
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path := f"{home}/{i}-{name}")
        # What the stage before wrote has been read for the last time.
        for old in written:
            delete(spark, old)
        written = [path]
        docs = spark.read.parquet(path)
    return docs
