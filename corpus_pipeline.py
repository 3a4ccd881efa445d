"""From raw documents to token ids, in five stages over what each stage before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.llm import bpe, langid, mixing, probminhash, quality
from lindero.session import settle

QUALITY_LIMIT = 0.3   # a document scored below is rejected
RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    It learns from the labels of documents whose crc32 of doc_id leaves a remainder when divided
    by 5, so that the others can tell how well it does. Null and empty texts get the score of an empty
    passage; equal texts are kept or rejected alike. Nothing labelled: every score is a half and all
    stay. An empty table gives an empty table.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality.learn(docs, labels, remainder != 0)
    return (quality.score(docs, model).filter(F.col("quality_score") >= QUALITY_LIMIT)
            .select(*docs.columns))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, one or several, by the network's windows.

    Rejected are texts without a letter and those with too small a share of their letters in windows
    of one sure language; `Network.recognised` has the rule, which judges short texts more gently. A
    document of several languages has sure windows and is kept. Null and empty texts go; equal texts
    are kept or rejected alike. Nothing learned: texts with a letter stay. An empty table gives an
    empty table.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    network = langid.learn(docs, remainder != 2)
    return langid.keep_recognised(docs, network)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id.

    Null and empty texts are near nothing and stay; of repeated rows one stays; an empty table gives
    an empty table.
    """
    return probminhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weights of its source ask, three times at most.

    Null and empty texts count no words; a null source is a source of its own; repeated rows are
    taken alike; an empty table gives an empty table.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text of the mixture: doc_id, source, lang, n_tokens, ids.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows get equal
    ids; an empty table gives an empty table.
    """
    ranks = public_tokenizers.path(RANKS)
    encoded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), ranks,
                         public_tokenizers.PATTERN)
    return encoded.select("doc_id", "source", "lang", "n_tokens", "ids")


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("tokens", tokens),
]
# The classifiers and the signatures have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
