"""Information-theoretic sanitisation of personal data.

Entities to protect are what the base patterns find: e-mail and IP addresses, card and phone
numbers. A term (any word of letters outside of all spans) discloses an entity in so far as it
tells of it: over all documents, PMI(entity; term) = log2(N * both / (docs with entity *
(docs with term + 1))) is compared with the entity's own information log2(N / docs with entity).
From GENERALISE of it on, the term is generalised to a placeholder wherever it stands in a document
that holds the entity; from REMOVE on it is removed. `both` counts documents that have both, in
any place, and no support is asked for: an entity of one document is the rule. Every row is a document. The one added to a
term's documents is its smoothing, so that a term of few documents proves less than one of many.
Documents without the entity stay as they are.

Term counts cover the whole corpus. Only terms of documents with entities are in question; workers get a
bit set of fixed size of these terms' hashes, which thins what they count and changes no result. Counts go by
the terms' 64-bit hashes, summed by task before the exchange. What a text's terms disclose is joined to
the texts that hold an entity, by the text's hash; all others stay where they are.

Defined results: a null text is the empty one, without spans and sanitised to itself; rows may
repeat, and each counts as a document in the statistics, also with a null doc_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, sieve, task_memo, written

#: The kinds in order, and their patterns. A digit before an address can't start
#: another match, so the look-behind changes no result; it spares long digit runs a second look.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+")
NOT_DIGIT = re.compile(r"[^0-9]")

GENERALISE, REMOVE = 0.8, 0.95
#: Bits of the set of terms in question (2 MB), and terms that a task counts before it hands them on.
TERM_BITS, MOST_TERMS = 24, 200_000
REVEALS = "array<struct<entity:bigint,term:bigint,ratio:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of the address pattern, each found from its @ sign."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start and then kind; code points."""
    found: list[tuple[int, int, int]] = []
    if not text:
        return found
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{(*KINDS, 'term')[k]}:{a}:{b}" for a, k, b in spans])


def entity_key(kind: int, value: str) -> int:
    """One key for the ways to write an entity."""
    value = value.lower() if kind == 0 else value if kind == 1 else NOT_DIGIT.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") - (1 << 63)


def term_key(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, lower-cased term) of all words outside of all spans, which are sorted by start."""
    out, i, reach = [], 0, 0
    for m in WORD.finditer(text):
        a, b = m.span()
        while i < len(spans) and spans[i][0] < b:
            reach = max(reach, spans[i][2])
            i += 1
        if reach <= a:
            out.append((a, b, m.group().lower()))
    return out


def contexts(docs: DataFrame) -> DataFrame:
    """text_key, entity, term (hash; null: the entity itself) for each row of docs, each once."""

    def run(batches):
        keys: dict[str, int] = {}
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for text_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                if not spans:
                    continue
                terms: list = [None]
                for term in {term for _, _, term in free_terms(text, spans)}:
                    if term not in keys:
                        if len(keys) >= MOST_TERMS:
                            keys.clear()
                        keys[term] = term_key(term)
                    terms.append(keys[term])
                for k in {entity_key(s[1], text[s[0] : s[2]]) for s in spans}:
                    columns[0].extend([text_key] * len(terms))
                    columns[1].extend([k] * len(terms))
                    columns[2].extend(terms)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["text_key", "entity", "term"])

    return docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(task_memo(run), "text_key long, entity long, term long")


def _term_set(terms: DataFrame) -> np.ndarray:
    """The bit set of terms' hashes, put together from its words' parts."""
    at, bit = f"cast(shiftright(pmod(term, {1 << TERM_BITS}), 5) as int)", "shiftleft(cast(1 as bigint), cast(pmod(term, 32) as int))"
    words = terms.select(F.expr(at).alias("at"), F.expr(bit).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    found, out = words.toArrow(), np.zeros(1 << (TERM_BITS - 5), np.uint32)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def term_documents(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, docs: in how many rows of docs each term occurs; of terms in question, and of some others."""
    wanted = docs.sparkSession.sparkContext.broadcast(_term_set(terms))

    def counted(count: Counter) -> pa.RecordBatch:
        keys = np.fromiter(map(term_key, count), np.int64, len(count))
        n = np.fromiter(count.values(), np.int64, len(count))
        place = keys & ((1 << TERM_BITS) - 1)
        on = (wanted.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1
        return pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(n[on])], ["term", "n"])

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    count.update({w.lower() for w in set(WORD.findall(text))})
                    if len(count) >= MOST_TERMS:
                        yield counted(count)
                        count.clear()
        if count:
            yield counted(count)

    return docs.select("text").mapInArrow(task_memo(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("docs"))


def disclosures(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """entity, term (hash), ratio: terms whose PMI with the entity is at least GENERALISE of its information."""
    found = written(contexts(docs), "contexts") if found is None else found
    entities = found.where("term is null").groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    both = found.where("term is not null").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    pairs = written(both.join(entities, "entity"), "pairs")
    n = docs.count()
    counted = pairs.join(term_documents(docs, pairs.select("term")), "term")
    pmi = F.log2(F.lit(float(n)) * F.col("both") / (F.col("n_entity") * (F.col("docs") + 1)))
    own = F.log2(F.lit(float(n)) / F.col("n_entity"))
    ratio = F.when(own > 0, pmi / own).otherwise(0.0)
    return written(counted.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= GENERALISE), "disclosures")


def found_in(text: str, known) -> list[tuple[int, int, int, float]]:
    """All spans of text (start, kind number, end, ratio); kind 4 is a disclosing term. known(entity) gives {term hash: ratio}."""
    spans = base_spans(text)
    if not spans:
        return []
    reveals: dict[int, float] = {}
    for key in {entity_key(k, text[a:b]) for a, k, b in spans}:
        for term, ratio in (known(key) or {}).items():
            reveals[term] = max(reveals.get(term, 0.0), ratio)
    terms = [(a, 4, b, reveals[key]) for a, b, t in free_terms(text, spans) if (key := term_key(t)) in reveals] if reveals else []
    return sorted([(a, k, b, 1.0) for a, k, b in spans] + terms)


def sanitised(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """text with base spans and generalised terms as placeholders, and removed terms gone."""
    out, at = [], 0
    for start, kind, end, ratio in spans:
        if start >= at:
            out.append(text[at:start])
            out.append(f"[{(*KINDS, 'term')[kind].upper()}]" if kind < 4 or ratio < REMOVE else "")
        elif end <= at:
            continue
        at = max(at, end)
    return "".join(out) + text[at:]


def _with_known(docs: DataFrame, reveals: DataFrame | None) -> DataFrame:
    """docs with a last column `reveals`: what the terms of its text disclose of the text's entities."""
    found = written(contexts(docs), "contexts")
    reveals = disclosures(docs, found) if reveals is None else reveals
    per_text = found.where("term is not null").join(reveals, ["entity", "term"]).groupBy("text_key").agg(F.collect_set(F.struct("entity", "term", "ratio")).alias("reveals"))
    rows = found.where("term is null").groupBy("text_key", "entity").agg(F.count(F.lit(1)).alias("n")).groupBy("text_key").agg(F.max("n").alias("n"))
    known = written(per_text.join(rows, "text_key").select(F.col("text_key").alias("text_key__"), "n", "reveals"), "known-texts")
    hit = F.coalesce(sieve(known, "text_key__")(F.xxhash64("text")), F.lit(False))
    none = F.lit(None).cast(REVEALS).alias("reveals")
    met = docs.where(hit).withColumn("text_key__", F.xxhash64("text"))
    out = [docs.where(~hit).select("*", none), join_counted(met, known, "text_key__").select(*docs.columns, "reveals"), met.join(known, "text_key__", "left_anti").select(*docs.columns, none)]
    return out[0].unionAll(out[1]).unionAll(out[2])


def _lookup(own):
    mine: dict[int, dict[int, float]] = {}
    for r in own or ():
        mine.setdefault(r["entity"], {})[r["term"]] = r["ratio"]
    return mine.get


def sanitise(docs: DataFrame, reveals: DataFrame | None = None) -> DataFrame:
    """docs' rows with n_email, n_ip, n_card, n_phone, base_sha256, spans, clean_text added.

    reveals: disclosures of another corpus; None takes those of docs."""
    rows = _with_known(docs.select("doc_id", "text"), reveals)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = found_in(text, _lookup(own)) if text else []
                base = [s[:3] for s in spans if s[1] < 4]
                count = Counter(s[1] for s in base)
                out.append((count[0], count[1], count[2], count[3], hashlib.sha256(joined(base).encode()).hexdigest(), joined([s[:3] for s in spans]), sanitised(text, spans) if spans else text))
            columns = list(zip(*out)) if out else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean_text"])

    return rows.mapInArrow(task_memo(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, clean_text string")


def clean_documents(docs: DataFrame) -> DataFrame:
    """docs with sanitised texts and n_chars to match; all else as it was."""
    rows = _with_known(docs, None)
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars")

    def run(batches):
        for batch in batches:
            texts, counts = batch.column(text_at).to_pylist(), batch.column(chars_at).to_pylist()
            for i, own in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spans = found_in(texts[i], _lookup(own)) if texts[i] else []
                if spans:
                    texts[i] = sanitised(texts[i], spans)
                    counts[i] = len(texts[i])
            out = batch.set_column(text_at, "text", pa.array(texts, pa.string())).set_column(chars_at, "n_chars", pa.array(counts, pa.int64()))
            yield out.select(docs_columns)

    docs_columns = docs.columns
    return rows.mapInArrow(task_memo(run), docs.schema)


def find_personal_data(docs: DataFrame) -> DataFrame:
    return sanitise(docs).drop("clean_text")


