"""The registered queries of this subpackage: ``QUERIES`` and, where SQL can express one, ``SQL``."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    decontamination,
    filter_audit,
    language,
    licenses,
    mixing,
    ngram_join,
    packing,
    prefix_trie,
    quality_model,
    quality_rules,
    secrets,
    toxicity,
)
from .common import crc_bucket, labelled_sample, row_key, same_key, table
from .duckdb_sql import SQL as SQL  # re-exported beside QUERIES

DECISION = 0.3


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket("doc_id", 3) == 1
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model, ["doc_id", held_out.alias("held_out")])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.control_conversation(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.windows(turns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = quality_rules.measures(docs, ["doc_id", "text"])
    base, further = quality_rules.base_rules(), quality_rules.method_rules()
    rules = quality_rules.plan_cascade(measured, base + further)
    judged = quality_rules.apply_cascade(measured, rules)
    fails = base[0].rejects | base[1].rejects
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails.alias("base_failed"), "kept"
    )


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.similarity_groups(docs, ngram_join.JoinSettings(shingle=3, threshold=Fraction(9, 10)))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chosen = mixing.select_documents(docs)
    return chosen.select("doc_id", "mix_domain", "lang", "source", "mix_epoch", "mix_tokens")


def _predicted(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= DECISION).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out: Column = crc_bucket("doc_id", 4) == 2
    settings = toxicity.TrainSettings()
    labels = table(spark, sf_dir, "labels").where(~held_out)
    sample = labelled_sample(docs, labels, "toxic", {0: settings.clean_rows, 1: settings.toxic_rows}, settings.seed)
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.text or ""))
    network = toxicity.train([r.text for r in rows], [r.label for r in rows], settings)
    return _predicted(toxicity.score_toxicity(docs, network, ["doc_id", held_out.alias("held_out")]))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secrets.spans_by_document(secrets.find_spans(docs))
    base = [r.kind for r in secrets.RULES if r.base]
    keyed = docs.select(*row_key())
    rows = keyed.join(spans, same_key(keyed, spans), "left").select(
        keyed["key_id"].alias("doc_id"), F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("found")
    )
    text = lambda some: F.array_join(
        F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(text(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out: Column = crc_bucket("doc_id", 5) == 0
    settings = quality_model.FitSettings()
    labels = table(spark, sf_dir, "labels").where(~held_out)
    sample = labelled_sample(docs, labels, "quality", {0: settings.rows_of_0, 1: settings.rows_of_1}, settings.seed)
    model = quality_model.fit(sample, settings)
    return _predicted(quality_model.score_quality(docs, model, ["doc_id", held_out.alias("held_out")]))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_license_scan,
        op3_chat_format,
        op4_quality_rules,
        op5_ngram_jaccard,
        op6_source_mixing,
        op7_toxicity,
        op8_decontamination,
        op9_secret_scan,
        op10_quality_model,
        op11_best_fit_packing,
        op12_filter_audit,
        op13_prefix_trie,
    )
}
