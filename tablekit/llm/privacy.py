"""Personal data: patterns, and the terms that give away what the patterns protect.

Base spans come from fixed patterns. Their texts are the protected entities. How strongly
another word reveals an entity is measured on the corpus: for a word ``t`` among the
``CONTEXT`` words around an entity ``e``, the information that both share,

    PMI(t, e) = log2( n(t, e) * N / (n(t) * n(e)) ),

is compared with all the information that ``e`` carries, IC(e) = log2(N / n(e)). All four
are numbers of distinct texts, copies of a text being one: ``N`` of all, ``n(t)`` of those
with the word, ``n(e)`` of those with the entity beside some word, and ``n(t, e)`` of those
with the word in a context of the entity. A word that shares at least ``SHARE`` of the
entity's information, in ``MIN_CONTEXTS`` distinct contexts or more, discloses it, and is a
span of kind ``term`` wherever it stands in a context of that entity. Sanitising writes a
placeholder of its kind for a base span (it is removed), and a more general word for a term.

Contexts are few, and they are shuffled once for each text: pairs of entity and word are
counted with partial sums. Words of pairs with enough contexts are counted in all texts; each
task sends a word's count once. If there are few such words, checked by number, tasks know
them and count no others. Of the texts only those that repeat are shuffled, if these are few,
else all, a copy per task. No list of a key is ever collected, except the spans of one document.

Null texts are empty. Rows with equal id and text are one document with a row each; a null
id is an id of its own. Other columns are not looked at. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablekit.llm import tables, texts

CONTEXT = 6
MIN_CONTEXTS = 3
SHARE = 0.5
MIN_TERM = 3
COUNT_CHUNK = 1 << 19
MAX_BROADCAST_TERMS = 100_000
MAX_BROADCAST_REPEATS = 100_000

# The kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'()[]{}<>.,;:!?|"
WORTH_A_LOOK = texts.table_of(b"@0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with what may stand before it, from its leftmost character on."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    double = str.maketrans("0123456789", "0246813579")
    tail = digits[-2::-2].translate(double)
    return (sum(map(int, digits[-1::-2])) + sum(map(int, tail))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield m.span()


FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    return sorted((a, rank, b) for rank, find in enumerate(FINDERS) for a, b in find(text))


def term_of(word: str) -> str:
    return word.strip(EDGES).lower()


def contexts(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, list[tuple[str, int, int]]]]:
    """Per base span: the entity, a number of its context, and the terms around it."""
    words = [m.span() for m in WORD.finditer(text)]
    starts = np.array([a for a, _ in words])
    taken = np.zeros(len(words), bool)
    for a, _, b in spans:
        low, high = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
        taken[max(low, 0) : high] = True
    for a, rank, b in spans:
        low = max(int(np.searchsorted(starts, a, "right")) - 1, 0)
        high = int(np.searchsorted(starts, b))
        near = range(max(0, low - CONTEXT), min(len(words), high + CONTEXT))
        around = []
        for i in near:
            if taken[i]:
                continue
            start, end = words[i]
            word = text[start:end]
            start += len(word) - len(word.lstrip(EDGES))
            term = term_of(word)
            if len(term) >= MIN_TERM:
                around.append((term, start, start + len(word.strip(EDGES))))
        said = " ".join(text[words[i][0] : words[i][1]] for i in near)
        print_ = int.from_bytes(hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        yield f"{rank}:{text[a:b].lower()}", print_, around


FOUND = (
    "doc long, text_hash long, spans array<struct<start:int,rank:int,stop:int>>, "
    "around array<struct<entity:string,context:long,term:string,start:int,stop:int>>"
)
SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32())])
NEAR = pa.struct(
    [("entity", pa.string()), ("context", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans: list[list] = []
        around: list[list] = []
        for block in texts.blocks(batch.column(2)):
            marks = np.concatenate([[0], np.cumsum(WORTH_A_LOOK[block.data])])
            worth = np.diff(marks[block.offsets]) > 0
            for row in range(block.rows):
                own, near = [], []
                if worth[row]:
                    text = block.text(row).decode("utf-8", "replace")
                    own = base_spans(text)
                    for entity, number, terms in contexts(text, own):
                        near += [
                            {"entity": entity, "context": number, "term": t, "start": a, "stop": b} for t, a, b in terms
                        ]
                spans.append([{"start": a, "rank": k, "stop": b} for a, k, b in own])
                around.append(near)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(SPAN)), pa.array(around, pa.list_(NEAR))],
            ["doc", "text_hash", "spans", "around"],
        )


def _count_terms(known):
    """Of each term, or each known one, the documents of a task that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else set(known.value)
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"]
            )
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms = set(map(term_of, WORD.findall(text)))
                counts.update(terms if wanted is None else terms & wanted)
                if len(counts) > COUNT_CHUNK:
                    yield flush()
        yield flush()

    return run


def _distinct_texts(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``text`` of each distinct text once; ``repeated`` holds the hashes of those with copies."""
    rows = rows.select("text_hash", "text")
    if repeated.isEmpty():
        return rows.select("text")
    if repeated.limit(MAX_BROADCAST_REPEATS + 1).count() > MAX_BROADCAST_REPEATS:
        return rows.dropDuplicates(["text_hash"]).select("text")
    repeated = F.broadcast(repeated)
    copies = rows.join(repeated, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    return rows.join(repeated, "text_hash", "left_anti").unionByName(copies).select("text")


def _document_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``term`` and ``n_t``, the rows that have it."""
    known = None
    if terms.limit(MAX_BROADCAST_TERMS + 1).count() <= MAX_BROADCAST_TERMS:
        known = rows.sparkSession.sparkContext.broadcast([r["term"] for r in terms.collect()])
    counted = rows.select("text").mapInArrow(_count_terms(known), "term string, n long")
    if known is None:
        counted = counted.join(terms, "term", "left_semi")
    return counted.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosures(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``entity`` and ``term`` of every pair in which the term discloses the entity."""
    some = base.where(F.size("around") > 0).groupBy("text_hash").agg(F.first("around").alias("around"))
    some = tables.staged(some, "contexts")
    once = some.select(F.explode("around").alias("x")).select("x.entity", "x.term", "x.context").distinct()
    pairs = once.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_contexts"))
    pairs = tables.staged(pairs.where(F.col("n_contexts") >= MIN_CONTEXTS).select("entity", "term"), "pairs")
    if pairs.isEmpty():
        return pairs
    both = F.array_distinct(F.transform("around", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))
    beside = some.select(F.explode(both).alias("x")).select("x.*").groupBy("entity", "term")
    beside = beside.agg(F.count(F.lit(1)).alias("n_te"))
    own = F.array_distinct(F.transform("around", lambda x: x["entity"]))
    entities = some.select(F.explode(own).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    copies = base.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"))
    copies, seen = tables.staged_counting(copies, "copies", n=F.count(F.lit(1)))
    distinct = _distinct_texts(rows, copies.where("n > 1").select("text_hash"))
    terms = _document_counts(distinct, pairs.select("term").distinct())
    total = F.lit(float(seen["n"]))
    shared = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e")))
    carried = F.log2(total / F.col("n_e"))
    known = pairs.join(beside, ["entity", "term"]).join(entities, "entity").join(terms, "term")
    return tables.staged(known.where((carried > 0) & (shared >= carried * SHARE)).select("entity", "term"), "disclosures")


def _keyed(docs: DataFrame) -> DataFrame:
    return tables.keyed(docs).select("doc", F.xxhash64("text").alias("text_hash"), "text")


def found(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Base spans per row (doc, text_hash, spans), and per document with disclosing terms
    these terms' spans (doc, text_hash, terms); None if there are none."""
    rows = _keyed(docs)
    base = tables.staged(rows.mapInArrow(_find, FOUND), "private")
    near = base.where(F.size("around") > 0).select("doc", "text_hash", F.explode("around").alias("x"))
    near = near.select("doc", "text_hash", "x.*")
    disclosed = disclosures(rows, base)
    terms = None
    if not disclosed.isEmpty():
        span = F.struct("start", F.lit(len(KINDS) - 1).alias("rank"), "stop")
        hits = near.join(disclosed, ["entity", "term"]).groupBy("doc", "text_hash")
        terms = hits.agg(F.collect_set(span).alias("terms"))
    return base.select("doc", "text_hash", "spans"), terms


def _with_terms(rows: DataFrame, terms: DataFrame | None) -> DataFrame:
    empty = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    if terms is None:
        return rows.withColumn("terms", empty)
    return rows.join(terms, ["doc", "text_hash"], "left").withColumn("terms", F.coalesce("terms", empty))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["stop"])), ","
    )


def reported(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256 and all spans."""
    base, terms = found(docs)
    out = _with_terms(base, terms)
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [
        (F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(KINDS[:4])
    ]
    everything = F.sort_array(F.concat("spans", "terms"))
    return out.select(
        tables.doc_id(), *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"), _listed(everything).alias("spans")
    )


def general_word(word: str) -> str:
    """What stands for a disclosing term."""
    if any(c.isdigit() for c in word):
        return "[NUMBER]"
    return "[NAME]" if word[:1].isupper() else "[TERM]"


def rewritten(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a placeholder for every span; spans that overlap share the first's."""
    parts, at = [], 0
    for start, rank, stop in sorted(spans):
        if start < at:
            if stop > at:
                at = stop
            continue
        parts.append(text[at:start])
        parts.append(f"[{KINDS[rank].upper()}]" if rank < 4 else general_word(text[start:stop]))
        at = stop
    return "".join([*parts, text[at:]])


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        terms, old = batch.column(names.index("_terms")), batch.column(names.index("_text"))
        out = []
        for text, own in zip(old, terms, strict=True):
            text = text.as_py()
            if text is not None:
                spans = base_spans(text) + [(s["start"], s["rank"], s["stop"]) for s in own.as_py()]
                text = rewritten(text, spans) if spans else text
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "_text"])


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all spans of their texts replaced; other columns stay."""
    _, terms = found(docs)
    row = tables.whole_row(docs).alias("_row")
    rows = docs.select(
        row,
        F.coalesce(docs["doc_id"].cast("long"), F.lit(tables.NULL_ID)).alias("doc"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash"),
    )
    rows = _with_terms(rows, terms).select("_row", F.col("_row.text").alias("_text"), F.col("terms").alias("_terms"))
    schema = StructType([rows.schema["_row"], rows.schema["_text"]])
    out = rows.mapInArrow(_sanitise, schema)
    return out.select(*[(F.col("_text") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])


def query(spark, folder: str) -> DataFrame:
    return reported(tables.read(spark, folder, "documents"))
