"""Secret scan through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match
must contain. The index lists, for each trigram that some query names, the documents holding it
(lower-cased). Intersecting the lists gives each rule's candidate documents, and only they are run
through the expression. Rules without a mandatory trigram scan every document.

Built-in expressions only. Index rows and spans are narrow; of the texts only those of candidate
documents are shuffled, by document, so a hot source spreads like any other.

Offsets count code points, end exclusive. Matches of one rule are leftmost and non-overlapping; a
match whose value (``group``) is shorter than ``least`` characters is dropped after it is found.

Results for odd input: a null text is the empty one and has no spans; repeated rows get the same
spans each; rows that share an id keep their own; extra columns are ignored.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, packed, row_key, same_key, split_by_membership, text_of

KEY = ["key_id", "key_text"]
#: Strings that the derivation spells out at one place of an expression before it gives up there.
SPELLED_OUT = 64


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def plain_pattern(self) -> str:
        """The same for engines that never backtrack and have no possessive loops. Nothing here depends on giving back."""
        return re.sub(r"(?<=[*+}])\+", "", self.pattern)


# A key goes to its END line; where that is missing (five dashes come first), through all base64 lines that follow,
# and what is written together with the last of them. Line breaks can be spelled \n. There are no largest numbers:
# possessive loops run in constant stack, whatever they repeat.
PEM_NAME = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
PEM_TO_END = "[^-]*+(?:-{1,4}+[^-]++)*+-----END " + PEM_NAME
PEM_LINES = r"(?:[\r\n]+[A-Za-z-]+: [^\r\n]*)*+(?:[\x09-\x0d\x20\\]*[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\r\n\\]*)++(?:[\x09-\x0d\x20\\]*[A-Za-z0-9+/]+=+)?"

# The kinds searched for, the base ones first. The order breaks ties of start. Secrets have no
# largest length, and a password all characters but blanks, quotes, angle brackets and slashes.
RULES = (
    SecretRule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        base=True,
    ),
    SecretRule("access", "AKIA[A-Z0-9]+", least=20, base=True),
    SecretRule("hex", "[0-9a-f]{24,}", least=24, base=True),
    SecretRule("github", "gh[opsu]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("private_key", f"-----BEGIN {PEM_NAME}(?:{PEM_TO_END}|{PEM_LINES})?"),
    SecretRule("login_url", r"""[A-Za-z][A-Za-z0-9+.-]{1,39}://[^\x00-\x20"<>/:@]*:[^\x00-\x20"<>/]{3,}@"""),
)

Clause = list[frozenset[str]]


def trigram_query(pattern: str) -> list[Clause]:
    """What every match holds, lower-cased: all clauses, of a clause one alternative, of an
    alternative all trigrams. Empty if nothing is mandatory."""
    return _clauses(sre_parser.parse(pattern))


def _spellings(op, arg) -> set[str] | None:
    """All strings an element can match, or None if they are many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is sre.SUBPATTERN:
        return _product(arg[3])
    if op is sre.BRANCH:
        parts = [_product(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _product(arg[2])
        return inner if inner is None or arg[0] == 1 else inner | {""}
    return None


def _product(items) -> set[str] | None:
    strings = {""}
    for op, arg in items:
        more = _spellings(op, arg)
        if more is None or len(strings) * len(more) > SPELLED_OUT:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _clauses(items) -> list[Clause]:
    clauses: list[Clause] = []
    run = {""}
    for op, arg in [*items, (None, None)]:
        more = _spellings(op, arg)
        if more is not None and len(run) * len(more) <= SPELLED_OUT:
            run = {a + b for a in run for b in more}
            continue
        clauses += _of_strings(run)
        run = {""} if more is None else more
        if more is None and op is sre.MAX_REPEAT and arg[0] >= 1:
            clauses += _clauses(arg[2])
        elif more is None and op is sre.SUBPATTERN:
            clauses += _clauses(arg[3])
    return clauses


def _of_strings(strings: Iterable[str]) -> list[Clause]:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return []
    return [sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)]


def trigram_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings: (trigram, key_id, key_text) of every document that holds one of ``trigrams``."""
    lowered = docs.select(*row_key(), F.lower(text_of()).alias("lowered"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("lowered"), t))
    return lowered.select(*KEY, F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[SecretRule]) -> DataFrame:
    """(key_id, key_text, kinds): per document the rules whose query its posting lists satisfy."""
    held = index.groupBy(*KEY).agg(F.collect_set("trigram").alias("held"))
    every = lambda parts: reduce(lambda a, b: a & b, parts)
    either = lambda parts: reduce(lambda a, b: a | b, parts)
    satisfied = [
        F.when(
            every(
                either(every(F.array_contains("held", t) for t in sorted(alternative)) for alternative in clause)
                for clause in trigram_query(rule.pattern)
            ),
            F.lit(rule.kind),
        )
        for rule in rules
    ]
    return held.select(*KEY, F.array_compact(F.array(*satisfied)).alias("kinds")).where(F.size("kinds") > 0)


def _matches(texts: DataFrame, rules: Sequence[SecretRule], applies) -> DataFrame:
    """Spans (key, kind, start, end) of ``rules`` in ``texts`` (key, text_read and what ``applies`` reads)."""

    def pieces(rule: SecretRule) -> Column:
        whole = F.regexp_extract_all("text_read", F.lit(rule.pattern), F.lit(0))
        value = F.regexp_extract_all("text_read", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
        between = F.split("text_read", rule.pattern, -1)
        found = F.filter(
            F.arrays_zip(whole.alias("whole"), value.alias("value"), between.alias("before")), lambda x: x["whole"].isNotNull()
        )
        kind = F.transform(found, lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("n"), F.length(x["before"]).alias("before"), F.length(x["whole"]).alias("whole"), F.length(x["value"]).alias("value")))
        return F.when(applies(rule) & F.col("text_read").rlike(rule.pattern), kind)

    parts = texts.select(*KEY, F.explode(F.flatten(F.array_compact(F.array(*map(pieces, rules))))).alias("m")).select(*KEY, "m.*")
    # Equal rows have equal matches: one copy is enough.
    once = parts.dropDuplicates([*KEY, "kind", "n"])
    upto = Window.partitionBy(*KEY, "kind").orderBy("n")
    ends = once.withColumn("end", F.sum(F.col("before") + F.col("whole")).over(upto))
    long_enough = reduce(
        lambda a, b: a & b, [(F.col("kind") != r.kind) | (F.col("value") >= r.least) for r in rules]
    )
    return ends.where(long_enough).select(*KEY, "kind", (F.col("end") - F.col("whole")).alias("start"), "end")


def find_spans(docs: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """(key_id, key_text, kind, start, end) of every secret, for ``docs`` (doc_id, text)."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    scanning = [r for r in rules if not trigram_query(r.pattern)]
    texts = docs.select(*row_key(), text_of().alias("text_read"))
    parts = []
    if scanning:
        parts.append(_matches(texts, scanning, lambda r: F.lit(True)))
    if indexed:
        trigrams = sorted({t for r in indexed for clause in trigram_query(r.pattern) for a in clause for t in a})
        wanted = cut_lineage(candidates(trigram_index(docs, trigrams), indexed))
        likely, _ = split_by_membership(texts, F.col("key_text"), wanted, F.col("key_text"))
        # Equal rows have equal keys and spans: the join is from one row each.
        verified = likely.join(wanted, same_key(likely, wanted)).select(*[likely[k] for k in KEY], "text_read", "kinds")
        parts.append(_matches(verified, indexed, lambda r: F.array_contains("kinds", r.kind)))
    return reduce(DataFrame.unionByName, parts)


def spans_by_document(spans: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """(key_id, key_text, spans): all spans of a document by start, then by the order of ``rules``."""
    rank = reduce(lambda case, x: case.when(F.col("kind") == x[1].kind, x[0]), enumerate(rules), F).otherwise(len(rules))
    return spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))


def redact(docs: DataFrame, rules: Sequence[SecretRule] = RULES) -> DataFrame:
    """``docs`` with each stretch of overlapping or touching spans replaced by ``[secret]``."""
    found = cut_lineage(spans_by_document(find_spans(docs, rules), rules))
    keyed = docs.select(packed(docs), *row_key())
    likely, clean = split_by_membership(keyed, F.col("key_text"), found, F.col("key_text"))
    text = F.col("row.text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        cut = F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int")), F.lit("[secret]"))
        apart = (span["start"] > acc["at"]) | (acc["out"] == "")
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(apart, cut).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    joined = likely.join(found.withColumnsRenamed({k: f"found_{k}" for k in KEY}), F.col("key_id").eqNullSafe(F.col("found_key_id")) & (F.col("key_text") == F.col("found_key_text")), "left")
    masked = F.when(F.col("spans").isNotNull(), done).otherwise(text)
    redacted = joined.select(*[masked.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return redacted.unionByName(clean.select("row.*"))
