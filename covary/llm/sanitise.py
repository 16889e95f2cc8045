"""Personal data: patterns for direct identifiers, and information-theoretic
sanitisation of the terms that reveal them.

What a term tells about a protected entity is their pointwise mutual
information over the corpus, ``log2 p(e | t) / p(e)``; the entity holds
``log2 1 / p(e)`` bits. A term that leaves at most ``residual`` of these bits
open (one bit: whoever reads the term finds the entity in every second
document) discloses the entity. It is removed if it leaves next to nothing
open, and generalised to a mark of the entity's kind otherwise.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from covary.llm._common import attach, col, fresh, map_batches, saved, ship

#: Kinds of direct identifiers, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an identifier that are its context.
WINDOW = 8
#: Contexts that differ in which a term must stand beside an entity to count.
SUPPORT = 2
#: Bits about the entity that a disclosing term leaves open at most, and that
#: one leaves open at most to be removed instead of generalised.
RESIDUAL, REMOVE = 1.0, 0.1
#: Bytes of the filter of disclosing terms, at least and at most (64 bits a term between).
LEAST_BYTES, FILTER_BYTES = 1 << 17, 64 << 20

# Patterns that the contract fixes; e-mail domains, dotted numbers.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Terms that can reveal: three letters and more.
TERM = re.compile(r"[^\W\d_]{3,}")

_SENT: dict = {}


def emails(text: str) -> list[tuple[int, int]]:
    """Around each ``@``: what may stand before it, back to the last match,
    and a domain of two labels at least. One pass, whatever the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            out.append((start, done))
        at = text.find("@", done)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def ips(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers after the other, of every run of dotted numbers."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the direct identifiers, by start, then kind."""
    found = [(a, k, b) for k, finder in enumerate((emails, ips, cards, phones)) for a, b in finder(text)]
    return sorted(found)


def entity(text: str, kind: int, start: int, end: int) -> str:
    """The identifier in one form, however it was written."""
    value = text[start:end].lower()
    return KINDS[kind] + ":" + (value if kind < 2 else re.sub("[^0-9]", "", value))


def contexts(text: str, spans: list[tuple[int, int, int]], window: int = WINDOW):
    """Per span its entity, the terms of its context and the context's own
    hash: the smallest of its terms' hashes, which a copy with a few words
    changed mostly shares."""
    if not spans:
        return
    covered = sorted((a, b) for a, _, b in spans)
    words, i = [], 0
    for m in TERM.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if i == len(covered) or m.end() <= covered[i][0]:
            words.append(m)
    starts = [m.start() for m in words]
    for start, kind, end in spans:
        lo, hi = bisect_left(starts, start), bisect_left(starts, end)
        terms = {m.group().lower() for m in words[max(0, lo - window):lo] + words[hi:hi + window]}
        if terms:
            yield entity(text, kind, start, end), terms, min(xxhash.xxh64_intdigest(t) for t in terms)


def _evidence(docs: DataFrame, window: int) -> DataFrame:
    """``entity, term, context, docs``: in how many documents a term stands in
    a context of an entity; term null: in how many the entity occurs."""
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for text in batch.column(0).to_pylist():
                seen, first = set(), set()
                for who, terms, context in contexts(text or "", base_spans(text or ""), window):
                    context &= (1 << 63) - 1
                    for row in [(who, None, 0), *((who, t, context) for t in terms)]:
                        if row not in seen:
                            seen.add(row)
                            # a document counts once, with the first context of the pair
                            for c, v in zip(out, (*row, int(row[:2] not in first))):
                                c.append(v)
                            first.add(row[:2])
            types = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)],
                                             names=["entity", "term", "context", "docs"])

    return docs.mapInArrow(run, "entity string, term string, context long, docs long").groupBy(
        "entity", "term", "context").agg(F.sum("docs").alias("docs"))


def _frequencies(docs: DataFrame) -> DataFrame:
    """``term, df``: documents that hold a term, over all terms; counted per
    task before anything is shuffled."""
    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({w.lower() for w in TERM.findall(text or "")})
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), type=pa.int64())],
                                                 names=["term", "df"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.string()),
                                          pa.array(list(seen.values()), type=pa.int64())], names=["term", "df"])

    return docs.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing_terms(docs: DataFrame, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT,
                     residual: float = RESIDUAL, remove: float = REMOVE) -> DataFrame:
    """``term, entity, kind, bits, open, action``: per disclosing term the
    entity it tells most about.

    ``bits`` is the mutual information of term and entity, ``open`` what the
    term leaves open of the entity's own information. A term counts if it
    stands in ``support`` contexts that differ, leaves at most ``residual``
    bits open, and tells at least half of what there is to know (so a term
    beside an identifier that is everywhere does not). Every document counts,
    copies too; they share their contexts. No identifiers: no terms.
    """
    ship(docs.sparkSession)
    texts = docs.select(col(text_col).cast("string").alias("text"))
    pairs = saved(_evidence(texts, window), "pii-pairs")
    close = pairs.filter(F.col("term").isNotNull()).groupBy("entity", "term").agg(
        F.sum("docs").alias("both"), F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= support)
    close = saved(close, "pii-close")
    total = texts.count()
    alone = pairs.filter(F.col("term").isNull()).select("entity", F.col("docs").alias("entity_docs"))
    scored = close.join(_frequencies(texts), "term").join(alone, "entity")
    held = F.log2(F.lit(float(total)) / F.col("entity_docs"))
    left = -F.log2(F.col("both") / F.col("df"))
    scored = scored.select("term", "entity", (held - left).alias("bits"), left.alias("open"), held.alias("held"))
    scored = scored.filter((F.col("open") <= residual) & (F.col("bits") >= F.col("held") / 2))
    best = scored.groupBy("term").agg(F.min(F.struct("open", "entity", "bits")).alias("b"))
    return best.select("term", "b.entity", F.substring_index("b.entity", ":", 1).alias("kind"), "b.bits",
                       (F.col("b.open") + 0.0).alias("open"),
                       F.when(F.col("b.open") <= remove, "remove").otherwise("generalise").alias("action"))


def _filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms (two bits of 64 each), filled by the tasks."""
    n = max(1, terms.count())
    bits = 1 << (min(FILTER_BYTES, max(LEAST_BYTES, 8 * n)) * 8 - 1).bit_length()

    def run(batches):
        flags = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for at in _bits(t, bits):
                    flags[at >> 3] |= 1 << (at & 7)
        at = np.flatnonzero(flags)
        yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), pa.array(flags[at], type=pa.int64())], names=["at", "flags"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    merged = terms.select("term").mapInArrow(run, "at long, flags long").groupBy("at").agg(F.bit_or("flags").alias("flags"))
    for row in merged.toLocalIterator():
        out[row["at"]] = row["flags"]
    return out


def _bits(term: str, bits: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(term)
    return h % bits, (h >> 32) % bits


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id_col, base, more``.

    ``base`` holds the direct identifiers and ``more`` the disclosing terms
    outside them, as structs (start, end in code points, kind, action), by
    start. Null texts are empty, ids are kept as they are and may be null or
    repeat, an empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    terms = saved(disclosing_terms(docs, text_col, **options), "pii-terms")
    sent, key = docs.sparkSession.sparkContext.broadcast(_filter(terms)), uuid.uuid4().hex
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    span = "array<struct<start:int,end:int,kind:string,action:string>>"
    hit = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("term", StringType())])
    base = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                       StructField("kind", StringType()), StructField("action", StringType())])
    fields = StructType([StructField("base", ArrayType(base)), StructField("hits", ArrayType(hit))])

    def make():
        if key not in _SENT:
            _SENT.clear()
            _SENT[key] = (sent.value, {})
        flags, known = _SENT[key]
        bits = len(flags) * 8

        def is_term(t: str) -> bool:
            said = known.get(t)
            if said is None:
                said = all(flags[at >> 3] >> (at & 7) & 1 for at in _bits(t, bits))
                if len(known) > 500_000:
                    known.clear()
                known[t] = said
            return said

        any_term = bool(flags.any())

        def run(batch):
            spans, hits = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = base_spans(text)
                spans.append([{"start": a, "end": b, "kind": KINDS[k], "action": "remove"} for a, k, b in found])
                near = []
                if any_term and any(is_term(w.lower()) for w in set(TERM.findall(text))):
                    covered, i = sorted((a, b) for a, _, b in found), 0
                    for m in TERM.finditer(text):
                        while i < len(covered) and covered[i][1] <= m.start():
                            i += 1
                        t = m.group().lower()
                        if (i == len(covered) or m.end() <= covered[i][0]) and is_term(t):
                            near.append({"start": m.start(), "end": m.end(), "term": t})
                hits.append(near)
            return [spans, hits]
        return run

    marked = saved(map_batches(rows, make, fields).select("id", "base", "hits")
                   .withColumn("uid", F.monotonically_increasing_id()), "pii-marked")
    # the filter lets a few others pass: the terms themselves decide
    hits = marked.select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
    n = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    stats = saved(terms.join(n, "term").select("term", "kind", "action", "n"), "pii-asked")
    total = marked.agg(F.sum(F.size("hits"))).first()[0] or 0
    real = attach(hits, stats, ["term"], "n", total).filter(F.col("action").isNotNull())
    more = real.groupBy("uid").agg(F.sort_array(F.collect_list(
        F.struct("start", "end", "kind", "action"))).alias("more"))
    return (marked.select("uid", "id", "base").join(more, "uid", "left")
            .select(F.col("id").alias(id_col), "base", F.coalesce("more", F.array().cast(span)).alias("more")))


def _listed(spans, kind) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(
        kind(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: ``id_col, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_terms``; see :func:`found_spans`. Disclosing terms
    are listed as ``term``, after an identifier that starts at the same place."""
    found = found_spans(docs, id_col, text_col, **options)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias("n_" + k) for k in KINDS]
    base = _listed(F.col("base"), lambda s: s["kind"])
    both = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
                                               .cast("int").alias("order"), s["end"], s["kind"])),
        F.transform("more", lambda s: F.struct(s["start"], F.lit(len(KINDS) + 1).alias("order"), s["end"],
                                               F.lit("term").alias("kind")))))
    return found.select(col(id_col), *counts, F.sha2(base, 256).alias("base_sha256"),
                        _listed(both, lambda s: s["kind"]).alias("spans"), F.size("more").cast("long").alias("n_terms"))


def masked(text: str | None, spans: list[tuple[int, int, str, str]]) -> str | None:
    """``text`` with identifiers as ``[EMAIL]`` and so on, removed terms gone
    and generalised ones as ``[about EMAIL]``. Of spans that overlap the one
    that starts first stands for all."""
    if text is None:
        return None
    out, done = [], 0
    for start, end, kind, action in sorted(spans):
        if start >= done:
            out += [text[done:start], {"base": f"[{kind.upper()}]", "remove": "", "generalise": f"[about {kind.upper()}]"}[action]]
            done = end
        elif end > done:
            done = end
    return "".join(out) + text[done:]


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``text_col`` masked (:func:`masked`), all other columns as
    they are. Spans meet their rows by a number of the row's own, so ids may
    repeat or be null."""
    uid, text, clean = (fresh(x, docs.columns) for x in ("row_uid", "row_text", "row_clean"))
    rows = saved(docs.withColumn(uid, F.monotonically_increasing_id()), "pii-rows")
    names = [fresh(x, rows.columns) for x in ("found_uid", "found_base", "found_more")]
    found = found_spans(rows, uid, text_col, **options).toDF(*names)
    joined = rows.join(found, F.col(uid) == F.col(names[0]))
    at, b, m = (joined.columns.index(c) for c in (text_col, *names[1:]))

    def make():
        def run(batch):
            return [[masked(t, [(s["start"], s["end"], s["kind"], "base") for s in base]
                            + [(s["start"], s["end"], s["kind"], s["action"]) for s in more])
                     for t, base, more in zip(*(batch.column(i).to_pylist() for i in (at, b, m)))]]
        return run

    out = map_batches(joined, make, StructType([StructField(clean, StringType())]))
    return out.select(*[col(clean).alias(c) if c == text_col else col(c) for c in docs.columns])
