"""Operators that SQL can't express, against plain versions, round trips and held-out accuracy."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from logtally.llm import chat, decontamination, language, licenses, ngram_join, quality_model, queries, secrets, toxicity
from logtally.llm.components import components

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# -- chat ------------------------------------------------------------------------------------------


@given(st.text(alphabet="<|\\im_startend>a\n", max_size=30), st.text(alphabet="<|\\n\n>a", max_size=8))
def test_escapes_come_back(text, role):
    head, body = chat.render(role, text)
    assert [x[:2] for x in chat.read_back(head + body)] == [(role, text)]


@settings(max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.integers(0, 60)), max_size=25), st.integers(20, 120), st.integers(0, 60))
def test_windows(turns, budget, history):
    plan = chat.WindowSettings(budget, history)
    given_turns = [(role, str(i), tokens) for i, (role, tokens) in enumerate(turns)]
    found = list(chat.plan_windows(given_turns, plan))
    new = [t.text for held, repeats in found for t in held[repeats:]]
    assert new == [t[1] for t in given_turns]
    size = {t[1]: t[2] + plan.overhead for t in given_turns}
    for number, (held, repeats) in enumerate(found):
        names = [t.text for t in held]
        assert len(set(names)) == len(names)
        if turns[0][0] == "system":
            assert names[0] == "0"
        if len(held) - repeats > 1:
            assert sum(size[n] for n in names) <= budget
        repeated = [n for n in names[:repeats] if not (n == "0" and turns[0][0] == "system")]
        assert sum(size[n] for n in repeated) <= history
        assert number > 0 or repeats == 0


def test_chat_query_equals_sql(spark):
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, SF).collect()}
    rows = duckdb.sql(f"SELECT conv_id, turn, role, coalesce(text, '') AS text FROM '{SF}/conversations.parquet' ORDER BY 1, 2").fetchall()
    control = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    want: dict = {}
    for conv, _, role, text in rows:
        turns, loss = want.setdefault(conv, ([], []))
        turns.append(f"{role}\n{text}\n")
        if role == "assistant":
            loss.append(text)
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert got.keys() == want.keys()
    for conv, (turns, loss) in want.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(turns), sum(map(len, loss)), sha(loss))


# -- similarity join ---------------------------------------------------------------------------------


def near_texts(seed: int) -> list[str]:
    """Families of edited copies, many of them of a common passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    common = [word() for _ in range(12)]
    texts = []
    for _ in range(12):
        origin = common + [word() for _ in range(rng.choice([3, 10, 40, 200, 1200]))]
        for _ in range(rng.choice([1, 4, 14])):
            copy = list(origin)
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("shingle, threshold, parts", [(3, Fraction(9, 10), 1), (5, Fraction(8, 10), 3), (2, Fraction(6, 10), 1)])
def test_groups_equal_all_pairs(spark, monkeypatch, shingle, threshold, parts):
    monkeypatch.setattr(ngram_join, "TREE_MEMBERS", 3)
    texts = near_texts(shingle)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_groups(docs, ngram_join.JoinSettings(shingle, threshold, parts)).collect()}
    sets = []
    for text in texts:
        words = text.lower().split()
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))})
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_classes_not_ids_are_compared(spark):
    """Null, repeated and clashing ids lose no link and no text, and leave no copy."""
    first, second = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    alone, unnamed = " ".join(f"c{i}" for i in range(60)), " ".join(f"d{i}" for i in range(60))
    rows = [(3, first), (10, first), (10, second), (11, second), (12, second + " more"), (10, alone), (5, first), (5, first)]
    rows += [(None, first), (None, unnamed), (None, unnamed), (None, unnamed + " more"), (20, alone + " x"), (20, alone + " x"), (7, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(docs).collect()), key=str)
    unnamed_kept = [t for i, t in kept if i is None]
    assert len(unnamed_kept) == 1 and unnamed_kept[0].startswith(unnamed)
    assert [x for x in kept if x[0] is not None] == sorted([(3, first), (10, second), (10, alone), (7, ""), (7, "")], key=str)
    apart = spark.createDataFrame([(3, first), (4, first), (4, second), (11, second + " more")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.similarity_groups(apart).collect()} == {(3, 3), (4, 3), (11, 3)}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    rule = ngram_join.JoinSettings(3, Fraction(8, 10))
    origin = rng.integers(1, 1 << 63, (6, 900), dtype=np.uint64)
    sets = []
    for _ in range(150):
        base = origin[rng.integers(6)][: rng.integers(20, 900)]
        keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.2])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(1, 1 << 63, rng.integers(0, 20), dtype=np.uint64)])))
    sets.sort(key=len)
    bits = np.vstack([ngram_join.folded(ngram_join.signature(s)) for s in sets])
    sizes = np.array([len(s) for s in sets])
    labels = rng.integers(0, 140, len(sets))
    found = {(i, j) for a, b in ngram_join.tree_pairs(bits, sizes, labels, rule) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    for j in range(len(sets)):
        for i in range(j):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if labels[i] != labels[j] and 10 * shared >= 8 * (sizes[i] + sizes[j] - shared):
                assert (i, j) in found
    assert len(found) < 0.5 * len(sets) ** 2 / 2


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for p in links for x in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in links)}


# -- decontamination -----------------------------------------------------------------------------------


def plain_tiles(item, doc, least):
    """Greedy string tiling, word by word."""
    taken_item, taken_doc, found = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in taken_item and b + n not in taken_doc:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return found
        found.append((a, b, n))
        taken_item |= set(range(a, a + n))
        taken_doc |= set(range(b, b + n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.lists(st.integers(0, 3), max_size=60), st.integers(2, 5))
def test_tiling(item, doc, least):
    least = min(least, len(item))
    found = decontamination.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), least)
    used_item = [i for a, _, n in found for i in range(a, a + n)]
    used_doc = [i for _, b, n in found for i in range(b, b + n)]
    assert len(set(used_item)) == len(used_item) and len(set(used_doc)) == len(used_doc)
    assert all(n >= least and item[a : a + n] == doc[b : b + n] for a, b, n in found)
    plain = plain_tiles(item, doc, least)
    # Both take the longest first; ties may be broken otherwise, which greedy coverage can show.
    assert max((n for *_, n in found), default=0) == max((n for *_, n in plain), default=0)
    assert bool(found) == bool(plain)


def test_reordered_passage_is_found(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    parts = [words[i : i + 12] for i in range(0, 60, 12)]
    rng.shuffle(parts)
    moved = " ".join("filler here " + " ".join(p) for p in parts)
    docs = spark.createDataFrame([(1, moved), (2, " ".join(words[:14])), (3, " ".join(words).upper())], "doc_id long, text string")
    items = spark.createDataFrame([(7, ", ".join(words))], "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.find_leaks(docs, items).collect()}
    assert found.keys() == {1, 3} and found[1].coverage == 1.0 and found[1].n_tiles == 5 and found[3].n_tiles == 1


def test_leaks_equal_containment(spark):
    """On the test tables passages are whole: leaks are the documents that hold an item's words in order."""
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, LARGER).collect()}
    norm = "' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '".format
    want = duckdb.sql(
        f"SELECT doc_id, item_id FROM '{LARGER}/documents.parquet' d, '{LARGER}/benchmark.parquet' b WHERE contains({norm('d.text')}, {norm('b.text')})"
    ).fetchall()
    assert set(want) <= got and len(got) == len(set(want))


def test_candidates_equal_all_pairs(spark):
    """Shuffled pieces of items on both sides of the threshold, shared seeds, short items and repeated rows, whatever the filter."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(8)]
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [words(rng.randrange(1, 9)) for _ in range(8)] + [common + words(rng.randrange(4, 40)) for _ in range(12)]
    docs = []
    for _ in range(80):
        item = rng.choice(items)
        size = rng.choice([5, 6, 9, 14])
        parts = [item[i : i + size] for i in range(0, len(item), size)]
        rng.shuffle(parts)
        some = parts[: max(1, round(len(parts) * rng.choice([0.4, 0.6, 0.8, 1])))]
        docs.append(" ".join(w for p in some for w in ["gap", *p, "end"]))
    docs += docs[:5] * 20
    plain = {}
    for i, text in enumerate(docs[:80]):
        ids = {w: k for k, w in enumerate(sorted({*text.split(), *(w for x in items for w in x)}))}
        number = lambda x: np.array([ids[w] for w in x], np.uint64)
        for j, item in enumerate(items):
            cover = sum(n for *_, n in decontamination.tiles(number(item), number(text.split()), min(5, len(item)))) / len(item)
            if cover >= 0.6:
                plain[i, j] = cover
    rows = [(i if i < 80 else (i - 80) % 5, t) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    want = sorted((i, j, c) for (i, j), c in plain.items() for _ in range(21 if i < 5 else 1))
    for bits in (64, 1 << 23):
        found = decontamination.find_leaks(frame, bench, decontamination.TilingSettings(filter_bits=bits, salts=3)).collect()
        assert sorted((r.doc_id, r.item_id, r.coverage) for r in found) == want
    assert len(plain) > 40
    left = decontamination.drop_leaks(frame, bench).collect()
    assert {r.doc_id for r in left} == set(range(80)) - {i for i, _ in plain}


# -- licenses ---------------------------------------------------------------------------------------------


def test_licenses_equal_all_runs(spark):
    """Notices with words missing or added, just above and below what is needed, wrapped anywhere."""
    rng = random.Random(5)
    wanted = licenses.templates()
    assert any(t.need < len(t.words) for t in wanted)
    texts = []
    for t, (_, text) in zip(wanted, licenses.TEMPLATES, strict=True):
        for missing in (0, len(t.words) - t.need, len(t.words) - t.need + 1):
            for added in (0, 2, 40):
                gone = set(rng.sample(sorted(t.words), missing))
                words = [w for w in text.split() if w not in gone]
                for _ in range(added):
                    words.insert(rng.randint(0, len(words)), rng.choice(["xyz", "the", "a", "lesser"]))
                words = ["one", "two"] * rng.randint(0, 40) + words + ["three"] * rng.randint(0, 40)
                texts.append("".join(w + rng.choice([" ", " ", "\n", ", "]) for w in words))
    want = {}
    for i, text in enumerate(texts):
        words = text.replace(",", " ").split()
        best = {}
        for t in wanted:
            held = max(len(t.words & set(words[k : k + t.width])) for k in range(len(words)))
            if held >= t.need:
                best[t.label] = max(best.get(t.label, 0), held / len(t.words))
        want |= {(i, label): x for label, x in best.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.key_id, r.label): r.containment for r in licenses.match_templates(docs, wanted).collect()}
    assert got == want and any(x < 1 for x in want.values())


def test_license_wordings(spark):
    texts = [
        ("Released under MIT License", "mit"),
        ("This work is licensed under the GNU General Public License v3", "gpl-3"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the conditions are met", "bsd"),
        ("subject to the terms of the Mozilla Public\nLicense, v. 2.0. This Source Code Form is", "mpl-2"),
        ("the GNU Lesser General Public License, version 2", "lgpl"),
        ("released " + "one two three " * 20 + "under the " + "one two three " * 20 + "mit license", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    assert got == {i: label for i, (_, label) in enumerate(texts)}


# -- models ----------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{LARGER}/documents.parquet'").fetchall())
    rows = [r for r in queries.op1_language_id(spark, LARGER).collect() if r.held_out]
    assert rows and np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.97


def small_model(grams, scores):
    """Without words, and with the given scores of n-grams."""
    start = np.arange(len(grams) + 1) * 2
    kept = language.Scores({g: i for i, g in enumerate(grams)}, start, np.array([0, 1] * len(grams), np.int32), np.array(scores, np.float32).ravel())
    none = language.Scores({}, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    return language.LanguageModel(["a", "b"], none, kept, 5)


def read(model, texts):
    """Words as ``language.words_of`` cuts them."""
    found = [regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower()) for t in texts]
    return list(zip(*language.Reader(model).predict(pa.array(found, pa.list_(pa.string())))[:2], strict=True))


def test_unseen_words_back_off():
    found = read(small_model(["xy", "z"], [[0, 1], [2, 0]]), ["xy", "qz", "", None, "12 _", "q"])
    assert [x[0] for x in found] == ["b", "a", "und", "und", "und", "a"]


def test_padding_is_no_evidence():
    found = read(small_model(["xy", "^", "$"], [[0, 1], [0, 2], [0, 2]]), ["\u0436\u0437", "xy \u0436 \u0437 \u0436\u0437", "xy"])
    assert [x[1] for x in found] == [0, 0.25, 1] and found[1][0] == "b"


def plain_language(rows, texts):
    """Fit and scoring by hand: (language, score) of each text, None where a tie may fall either way."""
    cut = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower())
    words, grams = {}, {}
    for text, lang in sorted(set(rows)):
        for w in cut(text):
            words.setdefault(lang, Counter())[w] += 1
            padded = f"^{w}$"
            grams.setdefault(lang, Counter()).update(padded[i : i + n] for n in range(1, 6) for i in range(len(padded) - n + 1))
    langs = sorted(words)

    def scores(counts, name):
        share = [counts[x][name] / sum(counts[x].values()) for x in langs]
        mean = sum(share) / len(langs)
        return [math.log(1 + s / (0.1 * mean)) for s in share]

    def of(w):
        if any(w in words[x] for x in langs):
            return scores(words, w)
        padded = f"^{w}$"
        for n in range(min(5, len(padded)), 0, -1):
            known = [padded[i : i + n] for i in range(len(padded) - n + 1) if (n > 1 or 0 < i <= len(w)) and any(padded[i : i + n] in grams[x] for x in langs)]
            if known:
                return [sum(c) / len(known) for c in zip(*(scores(grams, g) for g in known), strict=True)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        each = [of(w) for w in cut(text)]
        if not each:
            out.append(("und", 0.0))
            continue
        total = [sum(c) for c in zip(*each, strict=True)]
        if any(sum(max(e) - x < 1e-4 for x in e) > 1 for e in [*(e for e in each if any(e)), total]):
            out.append(None)
            continue
        best = total.index(max(total))
        out.append((langs[best], sum(any(e) and e.index(max(e)) == best for e in each) / len(each)))
    return out


def test_language_equals_plain_version(spark):
    rng = random.Random(8)
    rows = []
    for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "abxyz")):
        rows += [(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))), lang) for _ in range(20)]
    texts = [t for t, _ in rows[::3]] + [" ".join("".join(rng.choice("abcdefgxyzqw") for _ in range(rng.randint(1, 6))) for _ in range(7)) for _ in range(40)]
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.fit(made), ["doc_id"]).collect()}
    want = plain_language(rows, texts)
    clear = {i: w for i, w in enumerate(want) if w}
    assert len(clear) > 20
    assert all(got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-9 for i, w in clear.items())


def test_language_fit_keeps_n_grams_off_the_driver(spark):
    words = [f"{i:x}".translate({48 + k: 103 + k for k in range(10)}) + "xyzw" for i in range(40_000, 52_000)]
    rows = [(i, " ".join(words[i::20]), "en") for i in range(20)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = language.fit(labelled, language.FitSettings(grams_per_language=10))
        assert tracemalloc.get_traced_memory()[1] < 10_000_000
    finally:
        tracemalloc.stop()
    assert len(model.words.names) == len(words) and len(model.grams.names) == 10


def test_small_languages_neither_win_nor_vanish(spark):
    rng = random.Random(5)
    aa, bb = ([f"{x}{''.join(rng.choice('klmno') for _ in range(6))}" for _ in range(3000)] for x in "ab")
    rows = [(i, " ".join(rng.choice(aa) for _ in range(12)), "aa") for i in range(600)] + [(1000 + i, " ".join(bb[12 * i : 12 * i + 12]), "bb") for i in range(2)]
    rows.append((2000, "\u0928\u092e\u0938\u094d\u0924\u0947 \u0926\u0941\u0928\u093f\u092f\u093e", "hi"))
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = [" ".join(rng.choice(aa[2000:]) for _ in range(12)) for _ in range(200)]
    assert sum(x[0] == "aa" for x in read(model, new)) >= 195
    assert [x[0] for x in read(model, [rows[600][1], rows[601][1]])] == ["bb", "bb"]
    docs = spark.createDataFrame([(0, "\u00b2 \u00bd"), (1, "\u0928\u092e\u0938\u094d\u0924\u0947 \u0926\u0941\u0928\u093f\u092f\u093e")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert got == {0: ("und", 0.0), 1: ("hi", 1.0)}
    assert len([w for w in model.words.names if "\u0928" in w]) == 2


def test_quality_held_out(spark):
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{LARGER}/labels.parquet'").fetchall())
    rows = [r for r in queries.op10_quality_model(spark, LARGER).collect() if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in rows]) > 0.9
    assert all(r.predicted for r in rows if marks[r.doc_id])


def test_neighbours_are_exact(spark):
    sample = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "int(doc_id % 2) AS label").where("doc_id < 60")
    model = quality_model.fit(sample)
    texts = [r.text for r in sample.limit(10).collect()]
    got = model.score(texts)
    for text, score in zip(texts, got, strict=True):
        v = model.vector(*quality_model.term_counts(text))
        sims = model.vectors @ (v / np.linalg.norm(v))
        best = np.argsort(-sims)[: model.settings.neighbours]
        weight = np.maximum(sims[best], 0) + 1e-6
        assert abs(score - (weight * model.labels[best]).sum() / weight.sum()) < 1e-4


def test_gradients():
    plan = toxicity.TrainSettings(hidden=3, width=3, window=5, stride=3, char_buckets=16)
    words = [["a", "bb", "ccc", "a", "d", "e", "bb"], ["d", "a"]]
    net = toxicity._start([*words, *words, *words], np.array([1, 0, 1, 0, 1, 0], np.float32), plan)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    names = sorted({w for ws in words for w in ws})
    index, mask, firsts = net.layout([7, 2], np.array([names.index(w) for ws in words for w in ws]))
    target = np.array([1.0, 0.0, 1.0])[: len(index)]
    parts = net.features(names)
    _, grads = net.gradients(parts, index, mask, target)
    rng = np.random.default_rng(0)
    for name, weight in net.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weight.shape)
            old, step = weight[at], 1e-3
            weight[at] = old + step
            up, _ = net.gradients(parts, index, mask, target)
            weight[at] = old - step
            down, _ = net.gradients(parts, index, mask, target)
            weight[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, name


def test_windows_cover_texts():
    plan = toxicity.TrainSettings()
    for n in (1, 4, 5, 31, 32, 33, 60, 61, 500):
        starts = list(toxicity.windows(n, plan))
        assert {i for a in starts for i in range(a, min(n, a + plan.window))} == set(range(n))


def test_toxicity_learns(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(2))
    text = lambda bad: " ".join([word() for _ in range(rng.randint(20, 90))] + (["scoundrel"] if bad else []) + [word() for _ in range(40)])
    labels = [i % 3 == 0 for i in range(240)]
    net = toxicity.train([text(y) for y in labels], labels, toxicity.TrainSettings(rounds=6))
    tests = [i % 2 == 0 for i in range(60)]
    scores = net.score([text(y) for y in tests])
    assert np.mean((scores >= 0.3) == tests) > 0.95
    # A text of many pieces scores as its worst window, wherever it is.
    assert net.score([" ".join(word() for _ in range(200_000)) + " you scoundrel"])[0] > 0.3


# -- secrets ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_matches_satisfy_their_trigram_query(rule):
    examples = {
        "assign": ["Password: hunter22", "API_KEY='abcdefg", "apikey=x", "ToKeN  : \"a"],
        "access": ["AKIA0", "AKIAAAAA"],
        "hex": ["0123456789abcdef01234567"],
        "github": ["ghp_" + "a" * 36, "gho_" + "B" * 40],
        "slack": ["xoxb-1234567890"],
        "google": ["AIza" + "x" * 35],
        "stripe": ["sk_live_" + "a" * 16],
        "jwt": ["eyJabcdefgh.eyJabcdefgh.abcdefgh"],
        "private_key": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"],
        "login_url": ["https://me:secret@"],
    }
    import re

    for text in examples[rule.kind]:
        assert re.search(rule.pattern, text)
        for clause in secrets.trigram_query(rule.pattern):
            assert any(all(t in text.lower() for t in alternative) for alternative in clause)


def test_whole_secrets_go(spark):
    body = "\n".join("Ab1+" * 16 for _ in range(30)) + "\nAb1="
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0A1B\n\n"
    cases = [
        (f"a {begin}\n{body}\n{end} b", "a [secret] b"),
        (f"a {begin}{head}{body}\n{end} b", "a [secret] b"),
        (f"a {begin}{head}{body}", "a [secret]"),
        (f"a {begin}\n{body}\n\n... some-text {begin}\n{body}\n{end} b", "a [secret]... some-text [secret] b"),
        ("a " + f"{begin}\n{body}\n{end}".replace("\n", "\\n") + " b", "a [secret] b"),
        ("a " + f"{begin}\n{body}".replace("\n", "\n    "), "a [secret]"),
        ("a -----BEGIN PGP PRIVATE KEY BLOCK-----\n\nlQ==\n-----END PGP PRIVATE KEY BLOCK----- b", "a [secret] b"),
        (f"the line {begin} begins a key - well-known", "the line [secret] begins a key - well-known"),
        (f"a {begin}\n" + "Ab1+" * 500_000, "a [secret]"),
        (f"{begin} " + "a-b " * 50_000, "[secret] " + "a-b " * 50_000),
        ("a https://me:" + "p%2F#" * 30 + "@host b", "a [secret]host b"),
        ("a redis://:p@ss=w&rd@host http://host:80/x@y", "a [secret]host http://host:80/x@y"),
        ("a postgresql+psycopg2://me:secret@host", "a [secret]host"),
        *[(f"a {x}{'a1' * 400} b", "a [secret] b") for x in ("ghp_", "xoxb-", "sk_live_")],
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i


# -- pipeline --------------------------------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage on the rows of the one before, decisions checked by other means."""
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
    ids = [[r.doc_id for r in t.select("doc_id").collect()] for t in tables]
    assert all(t.columns == columns for t in tables[:-1])
    assert [len(x) for x in ids[:-1]] == sorted((len(x) for x in ids[:-1]), reverse=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(not re.search(r"[^\W\d_]", texts[i] or "") for i in set(ids[0]) - set(ids[1]))
    # One of each group of near copies, and no two left that are alike.
    sets = {}
    for i in ids[1]:
        words = [w.lower() for w in re.split(r"[\x20\x09-\x0D]+", texts[i]) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    left = ids[2]
    assert not any(alike(a, b) for n, a in enumerate(left) for b in left[:n])
    assert all(any(alike(i, j) for j in ids[1] if j != i) for i in set(ids[1]) - set(left))
    leaked = {r.doc_id for r in queries.op8_decontamination(spark, SF).collect()}
    assert set(ids[2]) - set(ids[3]) == leaked & set(ids[2])
    masked = {r.doc_id: r.text for r in tables[4].collect()}
    assert masked.keys() == set(ids[3])
    assert not any(re.search(r"[0-9a-f]{24,}", t) for t in masked.values())
    changed = {i for i, t in masked.items() if t != texts[i]}
    assert all("[secret]" in masked[i] for i in changed)
    if any(secrets.RULES[1].pattern and re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", texts[i] or "") for i in ids[3]):
        assert changed
    assert set(ids[5]) <= set(ids[4]) and ids[5]
    assert corpus_pipeline.run(spark, SF).count() == len(ids[5])


def test_pipeline_language_stage(spark):
    """Letter noise goes, wrong labels are mended, clean rows stay as they are; columns of any name come through."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where("length(text) > 300")
    rng = random.Random(2)
    noise = [(900_000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(120)), rng.choice(["en", "de", "fr", "es", None]), "src1", 0) for i in range(15)]
    clean = docs.where("lang = 'de'").limit(12).selectExpr("doc_id + 800000 AS doc_id", "text", "'en' AS lang", "source", "n_chars")
    planted = docs.unionByName(clean).unionByName(spark.createDataFrame(noise, docs.schema)).selectExpr("*", "'mine' AS lang_pred", "1 AS margin")
    kept = {r.doc_id: r for r in corpus_pipeline.identify_language(spark, planted, LARGER).collect()}
    assert sum(i >= 900_000 for i in kept) <= 1
    assert sum(kept[800_000 + r.doc_id].lang == "de" for r in docs.where("lang = 'de'").limit(12).collect()) >= 11
    given = {r.doc_id: r.lang for r in docs.collect()}
    assert given.keys() <= kept.keys()
    assert np.mean([kept[i].lang == x for i, x in given.items()]) > 0.98
    assert {r.lang_pred for r in kept.values()} == {"mine"}


def test_pipeline_odd_input(spark, odd, empty):
    """Every stage takes nulls, repeated rows, an empty table and clashing names, and leaves the columns as they are."""
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SF)
            if name != "mixing":
                assert found.columns == docs.columns, name
                assert {r.key_id for r in found.collect()} <= {"mine"}, name
            assert found.count() <= docs.count() or name == "mixing"


@pytest.mark.parametrize("body", ["\n".join("Ab-_1+xZ" * 8 for _ in range(8)), "-\n" * 10_000 + "Ab1+" * 10], ids=["base64url", "dashes"])
def test_keys_of_any_kind_go(spark, body):
    begin, end = "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"
    head = "".join(f"\nName-{chr(65 + i)}: a-b-c" for i in range(25))
    docs = spark.createDataFrame([(0, f"a {begin}\n{body}\n{end} b"), (1, f"a {begin}{head}\n{body}\n{end} b"), (2, f"a {begin}{head}\n\n" + "Ab1+" * 16)], "doc_id long, text string")
    assert [r.text for r in secrets.redact(docs).orderBy("doc_id").collect()] == ["a [secret] b", "a [secret] b", "a [secret]"]
