"""The training-corpus pipeline: language ID, near-duplicates, decontamination, mixing, token packing.

Every stage works on all that its predecessor kept and takes (spark, docs, sf_dir); all but the last return the
columns of documents. run() writes each stage's rows as Parquet to the shared folder and reads them back.

Rows are judged one by one, by their own text: a null or repeated doc_id neither keeps nor drops another row, and columns
of any further name pass through. Empty tables give empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratavox.llm import decontaminate, language_id, mixing, queries, token_pack
from stratavox.llm.minhash_dedup import deduplicated
from stratavox.sources.store import Scratch, written

#: The least share of a text's n-grams that its language must know.
MIN_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null texts, texts without letters and other languages go. Without a
    labelled document nothing is known of languages, and all stay."""
    return language_id.known(docs, queries.language_model(docs), min_score=MIN_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8; the smallest id stays. Of
    repeated rows one stays; rows without words link with nothing."""
    return deduplicated(docs, words=5, low=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in the order of the block permutations: every document at least once, those of
    small sources repeated. A null source is a source."""
    return mixing.arranged(docs, mixing.mixed(docs, mixing.word_tokens(), **queries.MIX))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids in the order of the mix, as its files hold it, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_pack.packed(docs, queries.tokenizer_file(), order=token_pack.stored_order(docs))


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_dedup),
    ("decontaminate", benchmark_free),
    ("mixing", mix),
    ("token_pack", tokens),
]

#: SQL cannot express the n-gram filters, signatures or the tokenizer; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = Scratch(spark)
        docs = now.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            last.remove()
        last = now
    docs = written(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
    last.remove()
    return docs
