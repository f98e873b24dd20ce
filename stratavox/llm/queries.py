"""The registered queries of the training-data operators: thin readers around the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_rotation, decontaminate, language_id, mixing, oracles, ordinal_quality, periodic_runs, pii_semicrf, quality_forest, spelling, suffix_merge, token_pack, url_reputation
from .minhash_dedup import near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """(id, bad): a page is bad if it is rated of low quality or toxic."""
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.where(known).select(F.col("doc_id").alias("id"), bad.alias("bad"))


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")), URL_RULES)


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from the documents that are not held out."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(29))  # null and repeated ids differ by their texts
    return language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"), key=key)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.withColumn("held_out", language_id.held_out())
    return language_id.predict(rows, language_model(docs), ["doc_id", "held_out"])


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.packed(table(spark, sf_dir, "documents"), tokenizer_file())


#: Share of the greatest possible entropy, and the most repetitions of any source.
MIX = {"target_entropy": 0.95, "max_repeats": 4.0, "block_tokens": 1_000_000, "seed": 1}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.word_tokens(), **MIX)


def op5_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_forest.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"anomaly_{g}" for g in quality_forest.GROUPS))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_rotation.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",")
    return out.withColumn("loss_spans", spans)


def op8_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pii_semicrf.find(docs, pii_semicrf.fit(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, pii_semicrf.BASE_KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, low=80)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 0: toxic, 1: of low quality, 2: good
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)
    return ordinal_quality.graded_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), grade)


def op11_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_merge.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.stop - x.start)
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find_runs(table(spark, sf_dir, "documents"), arranged=periodic_runs.cycled).withColumn("best", periodic_runs.best_run())
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))))
    exponent = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling.variants(table(spark, sf_dir, "documents"), thin=97)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_reputation,
        op2_language_id,
        op3_token_pack,
        op4_mixing,
        op5_quality_forest,
        op6_decontaminate,
        op7_chat_rotation,
        op8_pii_semicrf,
        op9_minhash_dedup,
        op10_ordinal_quality,
        op11_suffix_merge,
        op12_periodic_runs,
        op13_spelling_variants,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_reputation": oracles.url_reputation(URL_RULES),
    "op4_mixing": oracles.mixing(**MIX),
    "op7_chat_rotation": oracles.CHAT_ROTATION,
    "op11_suffix_merge": oracles.suffix_merge(100),
    "op13_spelling_variants": oracles.spelling(97, 5, 3, 2),
}
