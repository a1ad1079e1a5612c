"""Secrets in texts, found by regular expressions behind a trigram inverted index.

From every pattern the index derives what a text must contain: a conjunction of runs,
each a choice of strings, each string a conjunction of trigrams. Postings, a row for each
document and query trigram it contains, are joined to these queries; per document the
trigrams of each string are counted, and a rule's candidates are the documents that
satisfy every run. Only candidates are searched with the pattern; rules whose pattern
forces no trigram search every text.

All is built of DataFrame functions. The queries' table has a fixed size, given by the
rules. Postings hold at most a row per document and query trigram; a frequent trigram
has many rows, but they are grouped by document. Candidate sets return to the texts by a
join on the id, and a text is searched whole in its own row.

Null texts are empty. Rows that share an id, or have none, share their candidates, which
makes them a superset and changes no result. Other columns are not looked at. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.llm import tables

MAX_STRINGS = 64


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds, in the order in which spans at one place are listed.
BASE = (
    Rule(
        "assign",
        "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|"
        + either_case("api") + "_?" + either_case("key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
# Published token formats.
FURTHER = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]+"),
)
RULES = BASE + FURTHER


# ------------------------------------------------- what a pattern demands


def _strings(node) -> set[str] | None:
    """All strings, in lower case, that a part of a pattern matches; None if too many."""
    kind, value = node
    if kind is kinds.LITERAL:
        return {chr(value).lower()}
    if kind is kinds.IN:
        if any(k is not kinds.LITERAL for k, _ in value):
            return None
        return {chr(c).lower() for _, c in value}
    if kind is kinds.SUBPATTERN:
        return _sequence(value[-1])
    if kind is kinds.BRANCH:
        parts = [_sequence(part) for part in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is kinds.MAX_REPEAT and value[1] <= 4:
        once = _sequence(value[2])
        if once is None:
            return None
        return {"".join(p) for n in range(value[0], value[1] + 1) for p in product(once, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def demands(pattern: str) -> list[list[frozenset[str]]]:
    """Runs, all of which a match needs; of a run's trigram sets one must be present."""
    runs, current = [], {""}
    for node in [*parser.parse(pattern), None]:
        more = _strings(node) if node is not None else None
        if more is not None and len(current) * len(more) <= MAX_STRINGS:
            current = {a + b for a in current for b in more}
            continue
        if all(len(s) >= 3 for s in current):
            runs.append(sorted({trigrams(s) for s in current}, key=sorted))
        current = {""} if more is None else more
    return runs


# --------------------------------------------------------------- the index


def postings(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """``trigram`` and ``doc`` for every wanted trigram that a text contains."""
    words = F.array(*[F.lit(t) for t in wanted])
    present = F.filter(words, lambda t: F.contains(F.col("lower"), t))
    lowered = rows.select("doc", F.lower("text").alias("lower"))
    return lowered.select("doc", F.explode(present).alias("trigram"))


def _literals(rows: DataFrame, names: tuple[str, ...], values: list[tuple]) -> DataFrame:
    """A small table of literals."""
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in values]
    return rows.sparkSession.range(1).select(F.inline(F.array(*entries)))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """Per document the kinds whose demands it meets, for rules that have demands."""
    terms, runs = [], []
    for rule in rules:
        found = demands(rule.pattern)
        if found:
            runs.append((rule.kind, len(found)))
        for r, run in enumerate(found):
            for s, choice in enumerate(run):
                terms += [(t, rule.kind, r, s, len(choice)) for t in sorted(choice)]
    if not terms:
        return None
    query = _literals(rows, ("trigram", "kind", "run", "choice", "size"), terms)
    needed = _literals(rows, ("kind", "runs"), runs)
    posted = postings(rows, sorted({t[0] for t in terms})).distinct()
    # Both tables have a fixed size, a few rows for each rule.
    hits = posted.join(F.broadcast(query), "trigram").groupBy("doc", "kind", "run", "choice", "size").count()
    met = hits.where(F.col("count") == F.col("size")).groupBy("doc", "kind").agg(F.countDistinct("run").alias("met"))
    met = met.join(F.broadcast(needed), "kind").where("met = runs")
    return met.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


# ------------------------------------------------------------------ search


def _found(rank: int, rule: Rule) -> Column:
    """Spans of a pattern: its matches alternate with the pieces between them."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    pieces, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    zipped = F.arrays_zip(
        F.transform(F.slice(pieces, 1, F.size(whole)), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("size"),
        F.transform(part, F.char_length).alias("part"),
    )
    span = "struct<start:int,rank:int,end:int,kind:string>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        spans = F.when(x["part"] >= rule.least, F.array_append(state["spans"], one)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    empty = F.array().cast(f"array<{span}>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.when(text.rlike(rule.pattern), F.aggregate(zipped, zero, step)["spans"]).otherwise(empty)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``text`` and ``found``: all spans by start, then by the rules' order."""
    rows = tables.keyed(docs)
    asked = candidates(rows, rules)
    if asked is None:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    else:
        rows = rows.join(asked, "doc", "left")
    parts = []
    for rank, rule in enumerate(rules):
        part = _found(rank, rule)
        if demands(rule.pattern):
            part = F.when(F.array_contains("kinds", rule.kind), part)
        parts.append(F.coalesce(part, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))
    found = F.sort_array(F.concat(*parts))
    return rows.select(tables.doc_id(), "text", found.alias("found"))


def query(spark, folder: str) -> DataFrame:
    out = scanned(tables.read(spark, folder, "documents"))
    kinds_found = F.transform("found", lambda s: s["kind"])
    counts = [
        (F.size(kinds_found) - F.size(F.array_remove(kinds_found, rule.kind))).cast("long").alias(f"n_{rule.kind}")
        for rule in BASE
    ]
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return out.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def _sql_kind(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
      SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least,
             unnest(generate_series(1, len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(p[:len(m)]) AS p
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g,
                   string_split_regex(text, '{pattern}') AS p FROM docs)"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(_sql_kind(i, r) for i, r in enumerate(RULES))}),
placed AS (
  SELECT doc_id, rank, kind, length(g) >= least AS sound, length(m) AS size,
         sum(length(p) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop
  FROM matches
),
spans AS (
  SELECT doc_id, rank, kind, CAST(stop - size AS BIGINT) AS start,
         kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span
  FROM placed WHERE sound
),
listed AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
         count(*) FILTER (rank = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
         string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (doc_id)"""
