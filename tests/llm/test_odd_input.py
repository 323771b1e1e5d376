"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from fractions import Fraction

import pytest

from logtally.llm import (
    chat,
    decontamination,
    language,
    licenses,
    mixing,
    ngram_join,
    quality_model,
    quality_rules,
    secrets,
    toxicity,
)


def by_id(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, []).append(r)
    return found


def op1(spark, docs):
    return language.identify(docs, language.fit(docs), ["doc_id"])


def op2(spark, docs):
    return licenses.scan_licenses(docs)


def op4(spark, docs):
    measured = quality_rules.measures(docs, ["doc_id", "text"])
    return quality_rules.apply_cascade(measured, quality_rules.plan_cascade(measured, quality_rules.base_rules() + quality_rules.method_rules()))


def op5(spark, docs):
    return ngram_join.similarity_groups(docs, ngram_join.JoinSettings(3, Fraction(9, 10)))


def op7(spark, docs):
    texts = ["you idiot go away now", "what a lovely day it is"] * 10
    small = toxicity.TrainSettings(rounds=1, hidden=4)
    return toxicity.score_toxicity(docs, toxicity.train(texts, [1, 0] * 10, small), ["doc_id"])


def op9(spark, docs):
    return secrets.redact(docs)


def op10(spark, docs):
    sample = spark.createDataFrame([(0, "plain words here", 1), (1, "###$$$ %%%", 0), (2, None, 1)], "doc_id long, text string, label int")
    return quality_model.score_quality(docs, quality_model.fit(sample), ["doc_id"])


@pytest.mark.parametrize("op", [op1, op2, op4, op5, op7, op9, op10], ids=lambda f: f.__name__)
def test_one_row_per_row(spark, odd, empty, op):
    found = op(spark, odd)
    rows = by_id(found)
    assert sum(map(len, rows.values())) == odd.count()
    assert len(rows[6]) == 2 and rows[6][0] == rows[6][1]
    assert op(spark, empty).count() == 0


def test_language(spark, odd):
    rows = by_id(op1(spark, odd))
    assert {rows[i][0].lang_pred for i in (1, 2, 3, 4)} == {"und"}
    assert rows[6][0].lang_pred == "de" and rows[0][0].lang_pred == "en"
    assert all(0 <= r.score <= 1 for x in rows.values() for r in x)


def test_language_without_training(spark, odd, empty):
    assert {r.lang_pred for r in language.identify(odd, language.fit(empty), ["doc_id"]).collect()} == {"und"}


def test_licenses(spark, odd):
    rows = by_id(op2(spark, odd))
    assert (rows[None][0].base_labels, rows[None][0].labels, rows[None][0].first_word) == ("mit", "mit", 6)
    assert rows[1][0].n_words == 0 and rows[9][0].n_words == 30_001


def test_rules(spark, odd):
    rows = by_id(op4(spark, odd))
    assert (rows[1][0].n_words, rows[1][0].kept) == (0, False)
    assert rows[9][0].n_repeat_words == 30_000
    # 12 + 8 words; the first eight come twice but for the stop after the last.
    assert rows[6][0].n_repeat_words == 16


def test_groups(spark, odd):
    rows = by_id(op5(spark, odd))
    assert rows[7][0].component_id == 0 and rows[6][0].component_id == 6
    assert [rows[i][0].n_shingles for i in (1, 2, 3, 5)] == [0, 0, 0, 1]
    assert rows[None][0].component_id is None


def test_redaction(spark, odd):
    rows = by_id(op9(spark, odd))
    assert rows[8][0].text == "[secret]' \U0001F600 then [secret] and [secret]"
    assert rows[1][0].text is None and rows[8][0].key_id == "mine"


def test_scores(spark, odd):
    for op in (op7, op10):
        rows = by_id(op(spark, odd))
        assert all(0 <= r.score <= 1 for x in rows.values() for r in x)
    assert by_id(op7(spark, odd))[1][0].score == 0


def test_leaks(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "the dog sat on the rug while the cat sat on the mat")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(odd, items).collect()}
    assert found == {(5, 3), (0, 4), (7, 4)}
    assert decontamination.find_leaks(empty, items).count() == 0
    assert decontamination.find_leaks(odd, items.limit(0)).count() == 0
    assert {r.doc_id for r in decontamination.drop_leaks(odd, items).collect()} == {None, 1, 2, 3, 4, 6, 8, 9}


def test_mixing(spark, odd, empty):
    chosen = mixing.select_documents(odd)
    assert chosen.count() > 0 and set(odd.columns) <= set(chosen.columns)
    assert mixing.select_documents(empty).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, None, None, 9), (1, 1, "assistant", "", 9), (None, None, "user", "x", 9), (1, 1, "assistant", "b", 9)],
        "conv_id long, turn long, role string, text string, window long",
    )
    rows = {r.conv_id: r for r in chat.digest(chat.windows(turns)).collect()}
    assert rows[1].n_turns == 3 and rows[1].loss_chars == 1 and rows[None].n_turns == 1
    assert chat.digest(chat.windows(turns.limit(0))).count() == 0
