"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlelens.llm import bpe, exact_dedup, langid, mixing, simhash
from bundlelens.llm.common import col
from bundlelens.session import remove, scratch, shared_dir

LEAST_CERTAINTY = 0.5
"""A document stays when its words' labels are this certain on average."""
NEEDED = ("doc_id", "text", "lang", "source")

ORACLE_SQL = None
"""The stages' hashes, models and tokens are beyond SQL; tests compare them with brute force."""


def _decided(docs: DataFrame, decide) -> DataFrame:
    """The rows that ``decide`` leaves, with the columns of ``docs``; others than those needed can't clash with a stage's results."""
    names = docs.columns
    held = [name if name in NEEDED else f"extra{i}" for i, name in enumerate(names)]
    found = decide(docs.select(*[col(name).alias(h) for name, h in zip(names, held)]))
    return found.select(*[F.col(h).alias(name) for name, h in zip(names, held)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a language go (no letters, or words whose labels are below ``LEAST_CERTAINTY`` on average).

    How many languages share a document doesn't matter.
    """
    learnt = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(True))
    model = langid.train(docs, learnt)
    clear = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("certainty") >= LEAST_CERTAINTY)
    return _decided(docs, lambda d: langid.identify(d, model).filter(clear))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of equal texts stays."""
    with exact_dedup.fresh_index(spark) as index:
        return _decided(docs, lambda d: exact_dedup.deduplicate(d, index).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group whose SimHashes (three-word shingles) are linked by 2 bits or fewer stays."""
    return _decided(docs, lambda d: simhash.near_duplicates(d, radius=2, words=3).filter("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: sources at their target weights; documents come once per use, in shuffled shards."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids (packed, 32 bits each) in place of the text, and the digest of their decoded text."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True, carry=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    A stage's intermediate tables are removed once its output is written, and that output once the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage_{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
