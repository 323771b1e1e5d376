"""What the queries return, as DuckDB SQL. Written from the contracts, by other means than the operators:
windows are counted as rows, license notices sought in every run of words, similar sets found by counting shared shingles."""

from __future__ import annotations

from . import licenses, mixing, secrets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    phrases = "\n    UNION ALL ".join(
        f"SELECT doc_id, {_quoted(label)} AS label, i FROM places WHERE "
        + " AND ".join(f"w[i + {k + 1}] = {_quoted(word)}" for k, word in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES
    )
    templates = ", ".join(
        f"({_quoted(t.label)}, [{', '.join(map(_quoted, sorted(t.words)))}], {t.need}, {t.width})" for t in licenses.templates()
    )
    return f"""
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), places AS (
    SELECT doc_id, w, unnest(range(len(w))) AS i FROM words
), hits AS (
    {phrases}
), base AS (
    SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY 1
), whole AS (
    SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), templates(label, t, need, width) AS (VALUES {templates}
), able AS (
    SELECT doc_id, w, label, t, need, width FROM whole, templates WHERE len(list_intersect(w, t)) >= need
), runs AS (
    SELECT doc_id, label, t, need, list_intersect(w[i:i + width - 1], t) AS held FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM able)
), found AS (
    SELECT doc_id, label, max(len(held) / len(t)::DOUBLE) AS containment FROM runs WHERE len(held) >= need GROUP BY 1, 2
), method AS (
    SELECT doc_id, list(label) AS labels, max(containment) AS best FROM found GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word,
    b.last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
    CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.best, 0.0::DOUBLE) END AS score
FROM words d LEFT JOIN base b USING (doc_id) LEFT JOIN method m USING (doc_id)
"""


QUALITY = """
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM places) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(3) r(k) GROUP BY 1
), figures AS (
    SELECT doc_id, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM words LEFT JOIN covered USING (doc_id)
), all_figures AS (
    SELECT *, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > 3 * n_words
        OR 10 * n_dup_lines > 3 * n_lines OR 10 * len(regexp_extract_all(text, '\\p{L}')) < 4 * word_chars
        OR 10 * len(regexp_extract_all(text, '(?m)(?:\\.\\.\\.|…)$')) > 3 * n_lines
        OR 10 * len(regexp_extract_all(text, '\\p{Lu}')) > 5 * word_chars) AS kept
FROM all_figures
"""

JACCARD = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY 1
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a
)
SELECT doc_id, n::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sizes s
"""


def _secrets_sql() -> str:
    parts = []
    for at, rule in enumerate(secrets.RULES):
        pattern = _quoted(rule.plain_pattern)
        parts.append(
            f"""SELECT doc_id, {at} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, {rule.least} AS least,
        regexp_extract_all(coalesce(text, ''), {pattern}, 0) AS m, regexp_extract_all(coalesce(text, ''), {pattern}, {rule.group}) AS g,
        string_split_regex(coalesce(text, ''), {pattern}) AS p FROM documents WHERE regexp_matches(coalesce(text, ''), {pattern})"""
        )
    return f"""
WITH matches AS (
    {" UNION ALL ".join(parts)}
), each AS (
    SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matches
), spans AS (
    SELECT doc_id, rank, kind, base, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s,
        length(m[i]) AS n FROM each WHERE length(g[i]) >= least
), named AS (
    SELECT *, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS name FROM spans
), found AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(name, ',' ORDER BY s, rank) FILTER (base) AS base, string_agg(name, ',' ORDER BY s, rank) AS spans FROM named GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)
"""


def _mixing_sql() -> str:
    s = mixing.MixSettings()
    weights = [s.domain_weights, s.lang_weights, s.source_weights]
    levels = ["mix_domain", "mix_lang", "mix_source"]
    steps = []
    for depth, child in enumerate(levels):
        parent = levels[:depth]
        by = f"PARTITION BY {', '.join(parent)} " if parent else ""
        weight = f"CASE {child} " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in sorted(weights[depth].items())) + " ELSE 1 END"
        source = f"JOIN budget{depth} USING ({', '.join(parent)})" if parent else ", (SELECT sum(n_tokens) * {0} // 100 AS budget FROM leaves)".format(s.budget_percent)
        names = ", ".join(levels[: depth + 1])
        steps.append(
            f"""nodes{depth} AS (
    SELECT {names}, sum(n_tokens)::HUGEINT * {s.max_epochs} AS capacity, any_value({weight})::HUGEINT AS weight FROM leaves GROUP BY {names}
), ranked{depth} AS (
    SELECT *, budget - coalesce(sum(capacity) OVER ({by}ORDER BY capacity::DOUBLE / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
        sum(weight) OVER ({by}ORDER BY capacity::DOUBLE / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
    FROM nodes{depth} {source}
), budget{depth + 1} AS (
    SELECT {names}, CASE WHEN capacity * weights <= weight * room THEN capacity ELSE
        weight * (budget - sum(CASE WHEN capacity * weights <= weight * room THEN capacity ELSE 0 END) OVER ({by.strip()}))
        // greatest(1, sum(CASE WHEN capacity * weights <= weight * room THEN 0 ELSE weight END) OVER ({by.strip()})) END AS budget
    FROM ranked{depth}
)"""
        )
    return f"""
WITH docs AS (
    SELECT doc_id, lang, source, coalesce(lang, '') AS mix_lang, coalesce(source, '') AS mix_source,
        CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web' WHEN right(source, 1) IN ('5', '6', '7') THEN 'reference' ELSE 'forum' END AS mix_domain,
        len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS mix_tokens FROM documents
), leaves AS (
    SELECT mix_domain, mix_lang, mix_source, sum(mix_tokens) AS n_tokens FROM docs GROUP BY ALL
), {", ".join(steps)}, planned AS (
    SELECT mix_domain, mix_lang, mix_source, CASE WHEN n_tokens > 0 THEN (budget // n_tokens)::INT ELSE 0 END AS whole,
        CASE WHEN n_tokens > 0 THEN budget % n_tokens ELSE 0 END AS rest
    FROM leaves JOIN budget3 USING (mix_domain, mix_lang, mix_source)
), keyed AS (
    SELECT *, md5('{s.seed}/' || (whole + 1) || '/' || doc_id) AS k FROM docs JOIN planned USING (mix_domain, mix_lang, mix_source)
), summed AS (
    SELECT *, sum(mix_tokens) OVER (PARTITION BY mix_domain, mix_lang, mix_source ORDER BY k) AS upto FROM keyed
)
SELECT doc_id, mix_domain, lang, source, unnest(range(1, whole + 1 + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END))::INT AS mix_epoch, mix_tokens
FROM summed
"""


FILTER_AUDIT = """
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), marks AS (
    SELECT doc_id, part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
        'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f FROM texts
), known AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
), failing AS (
    SELECT part, f.A::INT AS a, f.B::INT AS b, f.C::INT AS c, f.D::INT AS d, f.E::INT AS e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM marks LEFT JOIN known USING (doc_id) GROUP BY ALL
), cells AS (
    SELECT part, n, good, toxic, repeat('A', a) || repeat('B', b) || repeat('C', c) || repeat('D', d) || repeat('E', e) AS fails FROM failing
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, fails, contains(fails, filter_order[step]) AS failing,
        translate(fails, left(filter_order, step - 1), '') <> fails AS gone
    FROM cells, orders, (SELECT unnest(range(1, 6))::INT AS step)
), counted AS (
    SELECT part, filter_order, step, letter, sum(n) FILTER (NOT failing AND NOT gone) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed,
        sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
        sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM counted
"""

# CRC-32 of an id's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

PREFIX_TRIE = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT DISTINCT conv_id, {_CRC} % 4 AS h FROM turns
), rebuilt AS (
    SELECT c.conv_id, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE t.i <= h
    UNION ALL SELECT c.conv_id, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.i > h
), lists AS (
    SELECT c.conv_id, coalesce(list(sha256(length(role)::VARCHAR || ':' || role || text) ORDER BY i) FILTER (i IS NOT NULL), []) AS ids,
        coalesce(list(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) ORDER BY i) FILTER (i IS NOT NULL), []) AS words
    FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY 1
), prefixes AS (
    SELECT conv_id, d, array_to_string(ids[1:d], '') AS node, array_to_string(ids[1:d - 1], '') AS parent, coalesce(words[d], 0) AS words, d = len(ids) AS ends
    FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM lists)
), nodes AS (
    SELECT node, min(conv_id) AS conv_id, any_value(d) AS depth, any_value(parent) AS parent, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY 1
), families AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.parent = n.node) AS n_children
    FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.parent = p.node
), below AS (
    SELECT left(node, d * 64) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS d FROM families) GROUP BY 1
)
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM families JOIN below USING (node)
"""


SQL = {
    "op2_license_scan": _license_sql(),
    "op4_quality_rules": QUALITY,
    "op5_ngram_jaccard": JACCARD,
    "op6_source_mixing": _mixing_sql(),
    "op9_secret_scan": _secrets_sql(),
    "op12_filter_audit": FILTER_AUDIT,
    "op13_prefix_trie": PREFIX_TRIE,
}
