"""Personal data: pattern detection, and terms that reveal the detected entities.

Detection finds e-mail addresses, IP addresses, card and phone numbers in whole texts.
Sanitisation goes further: a word near an entity can give the entity away. Over the
whole corpus, a term's disclosure of an entity is its pointwise mutual information with
the entity over the entity's own information content (near: among the `WINDOW_TERMS` terms on
either side, however long the words are):

    PMI(t; e) / IC(e) = 1 + log P(e | t) / -log P(e)

P(e | t) is the share of the documents with t that have t near e, drawn towards P(e) as if
`prior` more contexts had been seen: few contexts say less. Different contexts are counted,
not documents, so copies of one text are no evidence. Terms at or above `threshold` are
generalised, those at or above `remove_at` removed, wherever any document has them: the
term alone reveals the entity.

Null texts count as empty. Offsets are code points, ends exclusive. Equal texts get equal
spans, whatever their ids, null ones too; an empty table gives an empty result; extra columns
pass through `payload` only. Texts of any length are searched whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import DOC_COLUMNS, LOWER, UPPER, ascii_lower, in_slices, map_texts, materialize, texts_of, whole_text
from skyloom.llm.sieve import marked, sieve_of, sifted

#: The kinds in the order in which they are listed, then the method's own.
KINDS = ("email", "ip", "card", "phone", "term", "gone")
#: Terms on each side of an entity that are near it.
WINDOW_TERMS = 7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM_IN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans(UPPER, LOWER)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so long runs of word characters cost nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind, end), sorted; kind is an index into KINDS."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in CARD.finditer(text):  # whatever holds two digits in a row; cheap tests first
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity_name(text: str, start: int, kind: int, end: int) -> str:
    value = text[start:end].translate(TO_LOWER)
    return f"{KINDS[kind]}:{value if kind < 2 else ''.join(c for c in value if c.isdigit())}"


def clear_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """The terms outside all spans, in their order; a word that a span cuts leaves its parts. Numbers are none."""
    out, at = [], 0
    for start, _, end in [*spans, (len(text), 0, len(text))]:
        if start > at:
            out += [(m[0].translate(TO_LOWER), *m.span()) for m in TERM_IN.finditer(text, at, start) if not m[0].isdigit()]
        at = max(at, end)
    return out


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Each entity with the terms on either side of it."""
    if not spans:
        return []
    terms, out = clear_terms(text, spans), []
    starts = [s for _, s, _ in terms]
    for start, kind, end in spans:
        before, after = bisect_left(starts, start), bisect_left(starts, end)
        out.append((entity_name(text, start, kind, end), terms[max(0, before - WINDOW_TERMS) : before] + terms[after : after + WINDOW_TERMS]))
    return out


MENTIONS = "array<struct<entity:string,terms:array<struct<term:string,start:int,end:int>>>>"
SPANS = "array<struct<start:int,kind:int,end:int>>"
SPAN_LISTS = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "kind", "end")]))
MENTION_LISTS = pa.list_(
    pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
)


def span_list(spans: list[tuple[int, int, int]]) -> list[dict[str, int]]:
    return [dict(zip(("start", "kind", "end"), x)) for x in spans]


def detect_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = ()) -> DataFrame:
    """Per input row: the_id, digest of the text, payload as p_*, spans, mentions."""

    def work(texts: list[str]) -> list[pa.Array]:
        spans = [detect(t) for t in texts]
        found = [[{"entity": n, "terms": [dict(zip(("term", "start", "end"), x)) for x in ts]} for n, ts in mentions(t, s)] for t, s in zip(texts, spans)]
        return [pa.array([span_list(s) for s in spans], SPAN_LISTS), pa.array(found, MENTION_LISTS)]

    whole = text_col in payload  # then the text goes to Python and back once
    carried = [F.col(c).alias("the_text" if c == text_col else f"p_{c}") for c in payload]
    rows = docs.select(
        F.col(id_col).cast("long").alias("the_id"),
        F.sha2(whole_text(text_col), 256).alias("digest"),
        *carried,
        *([] if whole else [F.col(text_col).cast("string").alias("the_text")]),
    )
    found = map_texts(rows, work, f"spans {SPANS}, mentions {MENTIONS}", keep_text=whole)
    return found.withColumnRenamed("the_text", f"p_{text_col}") if whole else found


def text_words(docs: DataFrame, *kept: Column, text_col: str = "text") -> DataFrame:
    """(kept, term) for each row and each different word of its text."""
    words = F.array_distinct(F.split(ascii_lower(whole_text(text_col)), SEPARATORS))
    rows = docs.select(*kept, words.alias("words"))
    return rows.select(*rows.columns[:-1], F.explode("words").alias("term"))


def term_frequencies(docs: DataFrame, terms: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(term, n_term): in how many rows' texts each of the given terms stands. Words are sifted and counted before they move."""
    counts = sifted(text_words(docs, text_col=text_col), "term", sieve_of(terms, "term")).groupBy("term").agg(F.count("*").alias("n_term"))
    return counts.join(terms, "term", "left_semi")


def term_places(found: DataFrame, docs: DataFrame, terms: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(digest, extra): the spans of the given terms (term, kind; a written table) in all texts that have any, outside the base spans."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        extra = []
        for text, hits in zip(texts_of(batch, "the_text"), batch.column("hits").to_pylist()):
            kinds = {h["term"]: h["kind"] for h in hits}
            extra.append(span_list([(s, kinds[t], e) for t, s, e in clear_terms(text, detect(text)) if t in kinds]))
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(extra, SPAN_LISTS)], names=["digest", "extra"])

    sieve = materialize(sieve_of(terms, "term"), "pii-sieve")
    written = sifted(text_words(docs, F.sha2(whole_text(text_col), 256).alias("digest"), text_col=text_col), "term", sieve)
    near = found.where(F.size("mentions") > 0).select("digest", F.explode("mentions").alias("m")).select("digest", F.explode("m.terms.term").alias("term"))
    hits = written.unionByName(sifted(near, "term", sieve)).distinct().join(terms, "term").groupBy("digest").agg(F.collect_set(F.struct("term", "kind")).alias("hits"))
    hits = materialize(hits, "pii-hits")
    texts = docs.select(F.sha2(whole_text(text_col), 256).alias("digest"), whole_text(text_col).alias("the_text"))
    texts = sifted(texts, "digest", sieve_of(hits, "digest"))
    texts = texts.groupBy("digest").agg(F.first("the_text").alias("the_text"))  # equal texts have equal places
    return in_slices(texts.join(hits, "digest"), work, f"digest string, extra {SPANS}")


def disclosing_terms(found: DataFrame, docs: DataFrame, n_docs: int, *, text_col: str = "text", threshold: float = 0.85, prior: float = 1.0) -> DataFrame:
    """(entity, term, disclosure) for the terms that reveal an entity, counts covering all documents; a written table."""
    near = found.select("digest", F.explode("mentions").alias("m")).select(
        "digest", F.col("m.entity").alias("entity"), F.transform("m.terms", lambda x: x["term"]).alias("terms")
    )
    near = near.withColumn("context", F.xxhash64("terms"))
    pairs = near.select("entity", "context", F.explode(F.array_distinct("terms")).alias("term"))
    # copies collapse before the distinct contexts are counted
    support = pairs.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    by_document = (
        found.select(F.monotonically_increasing_id().alias("rid"), F.explode("mentions").alias("m"))
        .select("rid", F.col("m.entity").alias("entity"), F.explode(F.array_distinct(F.transform("m.terms", lambda x: x["term"]))).alias("term"))
        .distinct()
    )
    together = by_document.groupBy("entity", "term").agg(F.count("*").alias("n_both")).join(support, ["entity", "term"])
    near_any = by_document.select("rid", "term").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    entities = by_document.select("rid", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    content = F.greatest(F.lit(1e-9), F.log(F.lit(float(max(2, n_docs))) / F.col("n_entity")))
    share = F.col("n_entity") / float(max(2, n_docs))
    given = lambda n: (F.col("contexts") * F.least(F.lit(1.0), F.col("n_both") / F.col(n)) + prior * share) / (F.col("contexts") + prior)
    disclosure = lambda n: 1 + F.log(F.least(F.lit(1.0), given(n))) / content
    # a term is in at least as many documents as it is near any entity in, so this bound loses no pair
    pairs = together.join(near_any, "term").join(entities, "entity").where(disclosure("n_near") >= threshold)
    pairs = materialize(pairs.select("entity", "term", "n_both", "n_entity", "contexts"), "pii-pairs")
    candidates = materialize(pairs.select("term").distinct(), "pii-candidates")
    frequency = term_frequencies(docs, candidates, text_col=text_col)
    revealing = pairs.join(frequency, "term").withColumn("disclosure", disclosure("n_term")).where(F.col("disclosure") >= threshold)
    return materialize(revealing.select("entity", "term", "disclosure"), "pii-terms")


def find_pii(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", payload: tuple[str, ...] = (), threshold: float = 0.85, remove_at: float = 0.98, prior: float = 1.0
) -> DataFrame:
    """Per input row: doc_id, base (spans by pattern), spans (base and terms, sorted), then `payload`."""
    found = materialize(detect_documents(docs, id_col=id_col, text_col=text_col, payload=payload), "pii-found")
    n_docs = found.count()
    with_entities = found.where(F.size("mentions") > 0)
    revealing = disclosing_terms(with_entities, docs, n_docs, text_col=text_col, threshold=threshold, prior=prior)
    kind = F.when(F.max("disclosure") >= remove_at, KINDS.index("gone")).otherwise(KINDS.index("term"))
    terms = materialize(revealing.groupBy("term").agg(kind.alias("kind")), "pii-kinds")
    extra = materialize(term_places(found, docs, terms, text_col=text_col), "pii-places")
    # only texts that may have terms travel to their spans
    tried = marked(found, "digest", sieve_of(extra, "digest"), "touched")
    met = tried.where("touched").join(extra, "digest", "left")
    joined = met.select(*found.columns, "extra").unionByName(tried.where("not touched").select(*found.columns, F.lit(None).cast(SPANS).alias("extra")))
    spans = F.array_sort(F.concat("spans", F.coalesce("extra", F.array().cast(SPANS))))
    return joined.select(
        F.col("the_id").alias("doc_id"), F.col("spans").alias("base"), spans.alias("spans"), *[F.col(f"p_{c}").alias(c) for c in payload if c != "doc_id"]
    )


def span_text(spans: str):
    """Spans as kind:start:end, comma-joined, in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def sanitise(text: str, spans) -> str:
    """Spans give way to their kind in brackets; revealing terms are generalised or, at the top, removed."""
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], x["kind"])):
        if x["start"] < at:  # overlaps one that is gone already
            at = max(at, x["end"])
            continue
        out += [text[at : x["start"]], "" if KINDS[x["kind"]] == "gone" else f"[{KINDS[x['kind']].upper()}]"]
        at = x["end"]
    return "".join([*out, text[at:]])


def sanitise_documents(docs: DataFrame) -> DataFrame:
    """The documents with their personal data gone, n_chars recounted; other columns as they are."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [t if t is None else sanitise(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        arrays = [pa.array(clean, pa.string()) if c == "text" else batch.column(c) for c in DOC_COLUMNS]
        return pa.RecordBatch.from_arrays(arrays, names=list(DOC_COLUMNS))

    rows = find_pii(docs, payload=DOC_COLUMNS).select(*DOC_COLUMNS, "spans")
    touched = rows.where(F.size("spans") > 0)
    changed = in_slices(touched, work, touched.select(*DOC_COLUMNS).schema).withColumn("n_chars", F.char_length("text").cast("long"))
    same = rows.where(F.size("spans") == 0).select(*DOC_COLUMNS).withColumn("n_chars", F.col("n_chars").cast("long"))
    return changed.unionByName(same)
