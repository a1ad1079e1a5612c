"""Quality rules: a table of thresholds, compiled into one projection.

Every measure is an expression of built-in functions over the whole text, every
rule compares two measures in whole numbers, and the verdict is the conjunction.
There is no shuffle and no state; a row's cost grows with its own length only.

A null text has no words and fails, as an empty one does. Rows are judged one by
one, so ties, repeats and null ids need no rule; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.llm import tables

SPACE_CLASS = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
GRAM = 5

# Frequent function words of the four languages.
STOP_WORDS = tuple(
    (
        "the and of to in is a that it for was on are as with be by this or an "
        "le la les de des du et un une en que qui dans pour est pas sur au par avec "
        "der die das und ist nicht ein eine zu den von mit dem im für auf sich als auch "
        "el los las y del se por con para una su lo como más"
    ).split()
)


@dataclass(frozen=True)
class Rule:
    """Fails a document where ``percent`` of ``whole`` is passed by ``part``.

    With ``least`` set, the document fails where the part falls short of it. Texts
    of fewer than ``from_words`` words are too short for the ratio to mean anything.
    """

    name: str
    part: str
    percent: int
    whole: str
    least: bool = False
    from_words: int = 0

    def fails(self) -> Column:
        part, bound = F.col(self.part) * 100, F.col(self.whole) * self.percent
        return (part < bound if self.least else part > bound) & (F.col("n_words") >= self.from_words)


# What fails always: too few words, or much of the text in repeated windows.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

RULES = (
    Rule("symbols", "n_symbols", 20, "n_words"),
    Rule("stop words", "n_stop_words", 4, "n_words", least=True, from_words=40),
    Rule("equal lines", "n_dup_lines", 50, "n_lines"),
    Rule("long words", "word_chars", 2000, "n_words"),
    Rule("short words", "word_chars", 150, "n_words", least=True),
)


def measured(docs: DataFrame) -> DataFrame:
    """All measures, beside ``row``, which holds all columns of the table."""
    text = F.col("_text")
    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    base = docs.select(tables.whole_row(docs).alias("row"), F.coalesce("text", F.lit("")).alias("_text"))
    base = base.select(
        "row",
        words.alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
    )
    base = base.select(
        "row",
        "n_symbols",
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    grams = F.when(
        F.col("n_words") >= GRAM,
        F.transform(
            F.sequence(F.lit(0), F.size("_hashes") - GRAM),
            lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(GRAM)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("_grams", grams).drop("_hashes")
    # Windows are ordered only where some window repeats.
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    ordered = F.sort_array(
        F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    base = base.withColumn("_ordered", F.when(repeats, ordered)).drop("_grams")
    twice = F.filter(
        "_ordered",
        lambda x, i: F.coalesce(F.get(F.col("_ordered"), i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(F.col("_ordered"), i + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    base = base.withColumn("_starts", starts).drop("_ordered")
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("words"), F.lit(-GRAM).alias("last")),
        lambda s, i: F.struct(
            (s["words"] + F.least(F.lit(GRAM), i - s["last"])).alias("words"), i.alias("last")
        ),
    )["words"]
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with ``base_failed``, the names of failed rules, and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    names = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules]))
    any_rule = reduce(lambda a, b: a | b, [r.fails() for r in rules], F.lit(False))
    return measured(docs).withColumns(
        {"base_failed": failed, "failed_rules": names, "kept": ~failed & ~any_rule}
    )


COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
)


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects.

    Taken by a generator: a filter would be pushed below the projections, and then
    all measures would be worked out again inside it.
    """
    chosen = F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")
    return judged(docs, rules).select(chosen).select("row.*")


def query(spark, folder: str) -> DataFrame:
    judgement = judged(tables.read(spark, folder, "documents"))
    return judgement.select("row.doc_id", *COLUMNS[1:])


def _sql_fails(rule: Rule) -> str:
    sign = "<" if rule.least else ">"
    return f"({rule.part} * 100 {sign} {rule.whole} * {rule.percent} AND n_words >= {rule.from_words})"


def sql_measures(table: str = "documents") -> str:
    """DuckDB twin of :func:`measured` with the verdict, one row per ``doc_id``."""
    space = r"[ \t\n\x0B\f\r]"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    fails = " OR ".join(_sql_fails(r) for r in RULES)
    return f"""
    WITH split AS (
      SELECT doc_id, coalesce(text, '') AS text,
             list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
      FROM {table}
    ), words AS (
      SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split
    ), grams AS (
      SELECT doc_id, i, w || ' ' || lead(w, 1) OVER d || ' ' || lead(w, 2) OVER d || ' '
             || lead(w, 3) OVER d || ' ' || lead(w, 4) OVER d AS gram
      FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), twice AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
                             FROM grams WHERE gram IS NOT NULL) WHERE n > 1
    ), repeats AS (
      SELECT doc_id, sum(least({GRAM}, i - before)) AS n_repeat_words
      FROM (SELECT doc_id, i, lag(i, 1, -{GRAM}) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice)
      GROUP BY doc_id
    ), measures AS (
      SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(len(list_filter(words, lambda w: w IN ({stop}))) AS BIGINT) AS n_stop_words,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM split LEFT JOIN repeats USING (doc_id)
    ), failed AS (
      SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed
      FROM measures
    )
    SELECT *, NOT base_failed AND NOT ({fails}) AS kept FROM failed"""


SQL = f"SELECT {', '.join(COLUMNS)} FROM ({sql_measures()})"
