"""Packing, filter audit and prefix trie against brute force; joining trees; the license SQL over runs of words."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from logtally.llm import filter_audit, licenses, ngram_join, packing, prefix_trie, quality_rules, tokens, toxicity
from logtally.llm.duckdb_sql import SQL

SF = "/root/testdata/sf0.001"
VOCABULARY = packing.PackSettings().vocabulary
ODD = [
    None, "", " \t\n", "İstanbul ΣΑΣ don't I'LL 12ab é é", "x\x1cy \x85z ﬁ a'sb 's ''s foo's.", "naïve, œuvre ŒUVRE ÿ Ÿ µm ªº",
    "日本語 mixed日本 हिन्दी", "ends <|endoftext|> and<|startoftext|>begins", "word " * 9_000, "tab\x0bfeed\x0cnbsp\xa0end", "same", "same",
]


# -- packing ---------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer():
    plain, fast = Tokenizer.from_file(VOCABULARY), tokens.WordTokenizer(VOCABULARY)
    texts = [t for t in ODD if t] + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    for text in texts:
        want = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert fast.ids(text.encode()) == want, text[:80]


def check_packed(rows, docs, capacity):
    """Every id of every document once, sequences gapless; gives their number."""
    plain = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc, text in docs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[doc, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark):
    docs = [*enumerate(ODD), (None, "no id"), (3, "one id twice")]
    docs += [(100 + r[0], r[1]) for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, ids string, length int").repartition(5)
    packed = packing.pack_documents(table, packing.PackSettings(with_ids=True)).collect()
    total = sum(r.length for r in packed)
    assert check_packed(packed, docs, 4096) <= -(-total // 4096) + 1
    made = packing.sequences(packing.pack_documents(table, packing.PackSettings(capacity=64, with_ids=True))).collect()
    assert sum(len(r.ids) for r in made) == total and all(len(r.ids) <= 64 for r in made)
    assert packing.pack_documents(table.limit(0)).count() == 0


@pytest.mark.parametrize("capacity, lengths", [(12, range(1, 13)), (12, [5, 7]), (9, [4]), (20, [3, 7, 11]), (30, [11, 16])])
def test_plan_uses_all_and_is_near_the_least(capacity, lengths):
    rng = random.Random(capacity)
    for size in (1, 5, 8):
        bag = [rng.choice(list(lengths)) for _ in range(size)]
        counts = np.bincount(bag, minlength=capacity + 1)
        patterns = packing.plan(counts)
        used = Counter()
        for p in patterns:
            assert sum(x * n for x, n in p.parts) <= capacity
            for x, n in p.parts:
                used[x] += n * p.times
        assert used == Counter(bag)

        def least(rest, rooms):
            if not rest:
                return len(rooms)
            best = least(rest[1:], [*rooms, capacity - rest[0]])
            for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
                best = min(best, least(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]]))
            return best

        assert sum(p.times for p in patterns) <= least(sorted(bag, reverse=True), []) + 1


def test_large_histograms_fill_up():
    rng = np.random.default_rng(3)
    for lengths in (np.minimum(4096, rng.lognormal(6, 1.2, 300_000).astype(int) + 1), np.ones(50_000, int), rng.integers(1, 200, 40_000)):
        counts = np.bincount(lengths, minlength=4097)
        patterns = packing.plan(counts)
        assert sum(p.times for p in patterns) <= -(-int(lengths.sum()) // 4096) + 1
        places = packing.Places.of(patterns)
        length = np.repeat(np.arange(4097), counts)
        number = np.concatenate([np.arange(n) for n in counts])
        sequence, offset = places.find(length, number)
        order = np.lexsort((offset, sequence))
        same = sequence[order][1:] == sequence[order][:-1]
        ends = (offset + length)[order]
        assert (offset[order][1:] == np.where(same, ends[:-1], 0)).all() and ends.max() <= 4096


# -- filter audit ------------------------------------------------------------------------------------


def test_audit(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "d#", "e"])
    texts = [None, "", "same text", "same text"] + [" ".join(word() for _ in range(rng.choice([3, 199, 200, 201, 400]))) for _ in range(40)]
    texts += [" ".join(f"w{i}" for i in range(250))] * 3
    docs = [(i if i % 9 else i // 2, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)] + [(None, texts[5], "en"), (None, texts[5], "en"), (1, texts[6], "fr"), (1, texts[6], "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 50, 2)] + [(4, 1, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "x", 7) for d in docs], "doc_id long, text string, lang string, part string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit_filters(table, marks).collect()}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    failing = []
    for i, t, lang in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {x for x, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)), ("D", re.search(r"[#$%&*|]", t)), ("E", i is not None and first[t] < i)) if bad}
        failing.append((lang or "", fails, i in good, i in toxic))
    want = {}
    for part in {f[0] for f in failing}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                mine = [f for f in failing if f[0] == part]
                alive = lambda f: not f[1] & set(order[: step - 1])  # noqa: B023, E731
                gone = [f for f in mine if alive(f) and letter in f[1]]
                shapley[letter] += len(gone)
                want[part, order, step] = (
                    sum(alive(f) and letter not in f[1] for f in mine), len(gone), sum(not alive(f) and letter in f[1] for f in mine),
                    sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone),
                )
        for (p, order, step), row in list(want.items()):
            if p == part:
                want[p, order, step] = (*row, shapley[order[step - 1]])
    assert got == want
    assert filter_audit.audit_filters(table.limit(0), marks).count() == 0
    assert filter_audit.audit_filters(table, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# -- prefix trie ---------------------------------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, key, role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    nodes, below = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    for node in nodes:
        if node:
            below.setdefault(node[:-1], []).append(node)
    out = {}
    for node in sorted(nodes, key=len, reverse=True):
        kids = below.get(node, [])
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", node[-1][1]) if w]) if node else 0
        ends = ",".join(map(str, sorted(c for c in nodes[node] if len(rebuilt[c]) == len(node))))
        out[node] = (
            min(nodes[node]), len(node), min(nodes[node[:-1]]) if node else None, len(nodes[node]), len(kids), sum(out[k][5] for k in kids) or 1,
            (len(nodes[node]) - 1) * words + sum(out[k][6] for k in kids), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return Counter(out.values())


@pytest.mark.parametrize(
    "settings",
    [prefix_trie.TrieSettings(), prefix_trie.TrieSettings(segment=4, container_bytes=200, sweep_rows=5, joined_ids=2)],
    ids=["one container", "bursts and segments"],
)
def test_trie(spark, settings):
    rng = random.Random(6)
    rows = [(None, 0, "user", "no id"), (7, None, "user", "first"), (7, 3, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie")]
    for conv in rng.sample(range(100), 60):
        for turn in range(rng.choice([1, 2, 3, 5, 11])):
            rows.append((conv, turn, rng.choice(["user", "user", "assistant"]), rng.choice(["a b", "a b", "a b", "c", " "])))
    # A group of equal conversations, and a long one.
    rows += [(200 + c, t, "user", f"same words {t}") for c in range(25) for t in range(6)] + [(300, t, "user", f"long {t}") for t in range(17)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    got = Counter(tuple(r) for r in prefix_trie.conversation_trie(turns, settings).collect())
    assert got == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    # crc32("21") % 4 > 1 and no conversation 20: nothing is left of one turn.
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "gone")]
    got = Counter(tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect())
    assert got == plain_trie(rows) and len(got) == 1


# -- joining trees ---------------------------------------------------------------------------------------


def test_forest_joins_what_links():
    """Less pairs than members, and over whole sets the very groups of all pairs, also where some fail by a hair."""
    rng = np.random.default_rng(2)
    rule = ngram_join.JoinSettings()
    origin = rng.integers(1, 1 << 63, (3, 400), dtype=np.uint64)
    sets = []
    for _ in range(300):
        base = origin[rng.integers(3)]
        changed = rng.integers(0, 60)
        sets.append(np.unique(np.concatenate([base[rng.permutation(400)[changed:]], rng.integers(1, 1 << 63, changed, dtype=np.uint64)])))
    sets.sort(key=len)
    bits = np.vstack([ngram_join.folded(ngram_join.signature(s)) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = ngram_join.SignatureTree(bits, sizes, rule)
    hopeful = ngram_join.Groups(np.arange(300))
    pairs = [(a, b) for i, j in tree.forest(hopeful, 0) for a, b in zip(i, j, strict=True)]
    assert len(pairs) < 300
    groups = ngram_join.Groups(np.arange(300))
    links = [(a, b) for i, j in tree.forest(groups, 0, lambda x, y: ngram_join.alike(sets[x], sets[y], rule)) for a, b in zip(i, j, strict=True)]
    root = list(range(300))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(300), 2):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if 10 * shared >= 8 * (sizes[a] + sizes[b] - shared):
            x, y = sorted((find(a), find(b)))
            root[y] = x
            assert hopeful.label[a] == hopeful.label[b]
    want = [find(i) for i in range(300)]
    assert [groups.label[i] for i in range(300)] == want and len(links) == 300 - len(set(want))


@pytest.mark.parametrize("open_pairs", [0, 4])
def test_many_copies_alike_in_part_only(spark, monkeypatch, open_pairs):
    """A thousand copies that are all like one text, but only in part like each other."""
    monkeypatch.setattr(ngram_join, "OPEN_PAIRS", open_pairs)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for i in range(1000):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice([2, 4, 5])):
            copy[at] = f"c{i}x{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"x{i}{k}" for k in range(60)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_groups(docs).collect()}
    assert all(got[i] == 0 for i in range(1001)) and all(got[i] == i for i in range(1001, 1021))


# -- licenses ---------------------------------------------------------------------------------------------


def test_license_sql_where_lines_and_runs_differ(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    scattered = " ".join(w + " one two three four" for w in re.split(r"\W+", mit))
    texts = [mit, scattered, "under the\nMIT license", "released under " + "the one " * 30 + "MIT License", None, "redistribution and use in source\nand binary forms, with or without modification, are permitted if conditions are met"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = con.sql(SQL["op2_license_scan"])
    want = {r[rows.columns.index("doc_id")]: dict(zip(rows.columns, r, strict=True)) for r in rows.fetchall()}
    got = {r.doc_id: r.asDict() for r in licenses.scan_licenses(docs).collect()}
    assert got == want
    assert got[0]["labels"] == "mit" and got[1]["labels"] == ""


# -- quality rules and toxicity -----------------------------------------------------------------------------


def test_cascade_puts_rejections_per_cost_first(spark):
    from pyspark.sql import functions as F

    docs = quality_rules.measures(spark.createDataFrame([(i, "word " * (i % 60) * 9) for i in range(3000)], "doc_id long, text string"), ["doc_id", "text"])
    slow = F.size(F.regexp_extract_all("text", F.lit("(?:w|o|r|d){1,4}(?= )"), F.lit(0))) < 180
    few, many, dear = (quality_rules.Rule(*x) for x in (("few", F.col("n_words") < 9), ("many", F.col("n_words") < 180), ("dear", slow)))
    assert [r.name for r in quality_rules.plan_cascade(docs, [few, dear, many])][0] == "many"
    # As selective as "many", but slow: after it.
    order = [r.name for r in quality_rules.plan_cascade(docs, [dear, many])]
    assert order == ["many", "dear"]
    judged = quality_rules.apply_cascade(docs, [many, dear])
    assert {r.failed_rule for r in judged.collect()} == {"many", None}


def test_expressions_are_whole_in_a_window():
    plan = toxicity.TrainSettings()
    for n in (33, 64, 65, 200):
        starts = list(toxicity.windows(n, plan))
        for at in range(n - 16):
            assert any(a <= at and at + 17 <= a + plan.window for a in starts) or n < 17


def test_expressions_are_found_at_every_offset():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(2))
    bad = "you utter fool of a knave".split()
    text = lambda y: " ".join([word() for _ in range(rng.randint(20, 90))] + (bad if y else []) + [word() for _ in range(40)])
    labels = [i % 3 == 0 for i in range(240)]
    net = toxicity.train([text(y) for y in labels], labels, toxicity.TrainSettings(rounds=6))
    planted = []
    for at in range(0, 70):
        filler = [word() for _ in range(70)]
        planted.append(" ".join(filler[:at] + bad + filler[at:]))
    assert (net.score(planted) >= 0.3).all()
    assert np.mean(net.score([" ".join(word() for _ in range(76)) for _ in range(40)]) >= 0.3) < 0.1
