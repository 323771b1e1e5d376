"""From raw documents to a training mix, in five stages over the operators of ``logtally.llm``.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the next stage's documents. All but the last return the columns of
documents. A stage decides by what its documents hold, never by what an earlier one computed.

The stages take null texts, ids and languages, repeated rows and empty tables as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtally.llm import decontamination, language, mixing, ngram_join, secrets
from logtally.llm.common import table
from logtally.session import write_scratch

#: A document is rejected if, with all the doubt that its few words leave, less than this share of them belongs to its
#: language, and not by ``CLEAR_MARGIN`` more than to the next one.
LEAST_LANGUAGE_SHARE = 0.42
CLEAR_MARGIN = 0.15
#: So is one of whose words, with that doubt, fewer than this share were seen in any other document.
LEAST_SEEN_SHARE = 0.12
#: A given language gives way to a prediction that leads by so much more than the doubt.
RELABEL_MARGIN = 0.2
LANGUAGE_SEED = 17
#: Near copies have many block keys for each document: so many passes, each of which shuffles a part of them.
KEY_PARTS = 2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, those whose words belong to no language more than to the
    others, and those whose words no other document has, go. ``lang`` becomes the prediction where it is null or clearly contradicted."""
    # Each half is judged by what the other half taught, so that no document vouches for its own words.
    half = F.pmod(F.xxhash64("text", F.lit(LANGUAGE_SEED)), F.lit(2))
    models = [language.fit(docs.where(half != k)) for k in (0, 1)]
    keep = [F.struct(*docs.columns).alias("document")]
    judged = [language.identify(docs.where(half == k), m if m.languages else models[1 - k], keep) for k, m in enumerate(models)]
    found = judged[0].unionByName(judged[1])
    doubt = 0.5 / F.sqrt("n_letter_words")
    nowhere = (F.col("score") + doubt < LEAST_LANGUAGE_SHARE) & (F.col("margin") < CLEAR_MARGIN)
    unheard = F.col("n_seen_words") / F.col("n_letter_words") + doubt < LEAST_SEEN_SHARE
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & ~nowhere & ~unheard)
    given = F.col("document.lang")
    wrong = (given != F.col("lang_pred")) & (F.col("margin") - doubt > RELABEL_MARGIN)
    lang = F.when(given.isNull() | wrong, F.col("lang_pred")).otherwise(given)
    return kept.select(*[lang.alias(c) if c == "lang" else F.col("document")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the one with the smallest id."""
    return ngram_join.keep_first(docs, ngram_join.JoinSettings(key_parts=KEY_PARTS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars``, where there is one, follows the text."""
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once per epoch they are taken in, with domain, tokens and epoch."""
    return mixing.select_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The language model and the trees have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = write_scratch(docs, f"pipeline-{name}")
    return docs
