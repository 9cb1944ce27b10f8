"""Repeated passages by content-defined chunks.

1. A gear rolling hash over the last 32 bytes cuts each text where its value is the least within
   RADIUS bytes on either side. That depends on the surroundings alone, so two texts that share
   a passage cut it at the same places, but for 64 bytes at its front and 32 at its end, wherever it stands in either.
2. Chunks are deduplicated by a 64-bit digest over all texts: one that stands in two different texts is shared.
   Counts are summed before the exchange, and very frequent chunks are joined by broadcast (`join_counted`), so a chunk
   that a third of all documents hold is no burden.
3. Neighbouring shared chunks, with the unshared one and some bytes on either side, are a text's
   regions; they cover whatever repeats in them. Texts with a region of SEED_WORDS words in shared
   chunks come together with it once, equal texts by one of them.
4. In a region every stretch of WINDOW_WORDS words gets a hash, and of each PICK neighbouring stretches the least
   one is counted over all texts. Two texts that share MIN_WORDS = WINDOW_WORDS + PICK - 1 words in
   sequence pick the same one of them. Picks found in two documents are confirmed repeats,
   and overlapping ones join into passages.

So a sequence of MIN_WORDS words or more that two documents share is found if the chunks within it hold
SEED_WORDS words (chunks are of 64 bytes on average; of passages of 51 words of European languages, about 280
bytes, 0.7 % hold fewer; MOST ends a chunk where the hash has no least value, as in "aaaa"), and no passage is reported that is not, but for its overlaps, made of repeated sequences of WINDOW_WORDS words.
Words are what stands between white space (`[\\x20\\x09-\\x0D]`), of any kind and number; hashes
are of 64 bits. Repeats within one document don't count.

A document whose whole text another document has is one passage if it has MIN_WORDS words. The first
occurrence, by doc_id, is the one kept; passages' bytes that occur in an earlier document are to be removed.

Defined results: a null or empty text has no passages; rows that repeat a doc_id are read as one
document's parts, whose spans follow each other in the order of their texts' hashes, and equal ones count
once; a row with a null doc_id is left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, task_memo, written

RADIUS, MOST, WINDOW, MARGIN = 32, 256, 32, 64
WINDOW_WORDS, PICK, SEED_WORDS = 42, 9, 6
MIN_WORDS = WINDOW_WORDS + PICK - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def gear_table() -> np.ndarray:
    """256 random 32-bit numbers, the same everywhere."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=2024) for b in range(256)], np.uint32)


GEAR = gear_table()
BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=2024) for b in range(256)], np.uint64)


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last 32 bytes, by doubling."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h, step = longer, step * 2
    return h


def _before(h: np.ndarray) -> np.ndarray:
    """The least of the RADIUS (a power of 2) values before each place, by doubling; the greatest number where there are fewer."""
    worst = np.uint64(1 << 32)
    low = np.concatenate([np.full(1, worst), h[:-1].astype(np.uint64)])
    step = 1
    while step < RADIUS:
        low[step:] = np.minimum(low[step:], low[:-step])
        step *= 2
    return low


def chunk_ends(data: bytes) -> np.ndarray:
    """Ends of the chunks: after every byte whose hash is the least within RADIUS, every MOST bytes where
    there is none, and the end."""
    size = len(data)
    if not size:
        return np.zeros(0, np.int64)
    h = gear_hashes(data)
    least = (h < _before(h)) & (h <= _before(h[::-1])[::-1])
    least[: WINDOW - 1] = False
    ends = np.append(np.flatnonzero(least) + 1, size)
    if ends[-2:].size == 2 and ends[-2] == size:
        ends = ends[:-1]
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > MOST:
        more = (gaps - 1) // MOST + 1
        step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.minimum(np.repeat(ends - gaps, more) + step * MOST, np.repeat(ends, more))
    return ends


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def spans_hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span: a polynomial of the values, from sums up to each place."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_POWER, len(values)), dtype=np.uint64)])
    return _mixed((upto[ends] - upto[starts]) * _powers(_INVERSE, int(starts.max(initial=0)) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text")


def chunks(keyed: DataFrame) -> DataFrame:
    """part (hash of the row's text), start, size, words, digest of every chunk of every whole text."""

    def run(batches):
        for batch in batches:
            parts, sizes, out = [], [], [[], [], [], []]
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                values = np.frombuffer(data, np.uint8)
                ends = chunk_ends(data)
                starts = np.concatenate([[0], ends[:-1]])
                begun = np.concatenate([[0], np.cumsum(np.diff(~SPACE[values], prepend=False) & ~SPACE[values])])
                parts.append(part)
                sizes.append(len(ends))
                for column, found in zip(out, (starts, ends - starts, begun[ends] - begun[starts], spans_hashed(BYTES[values], starts, ends).view(np.int64))):
                    column.append(found)
            if parts:
                kinds = (np.int32, np.int16, np.int16, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(parts, np.int64), sizes)), *(pa.array(np.concatenate(c).astype(k)) for c, k in zip(out, kinds))], ["part", "start", "size", "words", "digest"])

    return keyed.select("part", "text").mapInArrow(task_memo(run), "part long, start int, size short, words short, digest long")


def regions_of(starts, sizes, words) -> list[tuple[int, int]]:
    """Byte spans around neighbouring shared chunks of at least SEED_WORDS words."""
    out: list[list[int]] = []
    reach = MOST + MARGIN
    for a, n, w in sorted(zip(starts, sizes, words)):
        if out and a - reach <= out[-1][1] + reach:
            out[-1][1:] = [a + n, out[-1][2] + w]
        else:
            out.append([a, a + n, w])
    return [(max(0, a - reach), b + reach) for a, b, w in out if w >= SEED_WORDS]


def picked(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash in each PICK neighbouring ones, the last of equals."""
    if len(hashes) < PICK:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], PICK)
    return np.unique(len(hashes) - 1 - (np.arange(len(views)) + views.argmin(axis=1)))


def windows(texts: DataFrame) -> DataFrame:
    """part, first, lo, hi, key: the picked stretches of the regions of each text, as byte spans."""

    def run(batches):
        for batch in batches:
            parts, firsts, los, his, keys = [], [], [], [], []
            for part, first, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                a, b = word_edges(data)
                if len(a) < MIN_WORDS:
                    continue
                hashes = spans_hashed(BYTES[data], a, b)
                at = np.arange(len(a) - WINDOW_WORDS + 1)
                stretch = spans_hashed(hashes, at, at + WINDOW_WORDS)
                chosen = []
                for span in spans:
                    i, j = int(np.searchsorted(a, span["lo"])), int(np.searchsorted(b, span["hi"], "right")) - WINDOW_WORDS + 1
                    if j - i >= PICK:
                        chosen.append(i + picked(stretch[i:j]))
                if chosen:
                    c = np.unique(np.concatenate(chosen))
                    parts.append(np.full(len(c), part))
                    firsts.append(np.full(len(c), first))
                    los.append(a[c])
                    his.append(b[c + WINDOW_WORDS - 1])
                    keys.append(stretch[c].view(np.int64))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in ((parts, np.int64), (firsts, np.int64), (los, np.int32), (his, np.int32), (keys, np.int64))], ["part", "first", "lo", "hi", "key"])

    return texts.select("part", "first", "text", "spans").mapInArrow(task_memo(run), "part long, first long, lo int, hi int, key long")


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _passages(batches):
    for batch in batches:
        out = []
        for part, mine, found in zip(*(c.to_pylist() for c in batch.columns)):
            spans = _joined([(x["lo"], x["hi"]) for x in found])
            later = _joined([(x["lo"], x["hi"]) for x in found if x["earliest"] < mine])
            out.append((part, [{"lo": a, "hi": b} for a, b in spans], [{"lo": a, "hi": b} for a, b in later], sorted({x["earliest"] for x in found if x["earliest"] < mine})))
        columns = list(zip(*out)) if out else [()] * 4
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), span, span, pa.list_(pa.int64())))], ["part", "spans", "later", "firsts"])


SPANS = "array<struct<lo:int,hi:int>>"


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each doc_id: its repeated passages (byte spans of the UTF-8 text), the spans
    to remove, and the documents that hold the first occurrences."""
    keyed = _keyed(docs)
    cut = written(chunks(keyed), "chunks")
    shared = written(cut.groupBy("digest").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("digest", "n"), "shared")
    held = join_counted(cut, shared, "digest").select("part", "start", "size", "words").distinct()
    found = held.groupBy("part").agg(F.collect_list(F.struct("start", "size", "words")).alias("found"))

    def spans_in(batches):
        for batch in batches:
            out = [(p, [{"lo": a, "hi": b} for a, b in regions_of([c["start"] for c in f], [c["size"] for c in f], [c["words"] for c in f])]) for p, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            out = [x for x in out if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], ["part", "spans"])

    regions = found.mapInArrow(spans_in, f"part long, spans {SPANS}")
    n_words = F.when(F.octet_length("text") < 2 * MIN_WORDS - 1, 0).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    rows = written(keyed.select("doc_id", "part", F.octet_length("text").alias("size"), (n_words >= MIN_WORDS).alias("long")).distinct(), "texts")
    texts = written(rows.groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("size").alias("size"), F.first("long").alias("long")), "text-classes")
    asked = regions.join(texts.select("part", "first"), "part")
    one = keyed.join(asked, (keyed.part == asked.part) & (keyed.doc_id == asked["first"])).select(keyed.part, "first", "text", "spans").dropDuplicates(["part"])
    taken = written(windows(one), "windows")
    repeats = written(taken.groupBy("key").agg(F.min("first").alias("earliest"), F.min("part").alias("a"), F.max("part").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("key", "earliest", "n"), "repeats")
    passages = join_counted(taken, repeats, "key").groupBy("part", "first").agg(F.collect_list(F.struct("lo", "hi", "earliest")).alias("found")).mapInArrow(_passages, f"part long, spans {SPANS}, later {SPANS}, firsts array<long>")

    whole = lambda test: F.when(test, F.expr("array(named_struct('lo', 0, 'hi', cast(size as int)))"))
    copied = F.col("long") & (F.col("first") < F.col("last"))
    none = F.array().cast(SPANS)
    by_text = texts.join(passages, "part", "left").select("part", "first", F.coalesce(whole(copied), "spans", none).alias("spans"), F.coalesce("later", none).alias("later"), F.coalesce("firsts", F.array().cast("array<bigint>")).alias("firsts"), copied.alias("copied"), "size")
    again = F.col("copied") & (F.col("doc_id") > F.col("first"))
    each = rows.select("doc_id", "part").join(by_text.where(F.size("spans") > 0), "part").select("doc_id", "part", "spans", F.coalesce(whole(again), "later").alias("later"), F.when(again, F.array_union("firsts", F.array("first"))).otherwise(F.col("firsts")).alias("firsts"))
    width = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    text = lambda c: F.concat_ws(",", F.transform(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", c))), lambda x: x[c])), lambda x: F.concat_ws(":", x["lo"].cast("string"), x["hi"].cast("string"))))
    summed = each.groupBy("doc_id").agg(F.sum(F.size("spans")).cast("long").alias("n_passages"), F.sum(width("spans")).alias("repeat_bytes"), F.sum(width("later")).alias("removed_bytes"), text("spans").alias("passages"), text("later").alias("removed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_docs"))
    every = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    zero = F.lit(0).cast("long")
    return every.join(summed, "doc_id", "left").select("doc_id", *(F.coalesce(c, zero).alias(c) for c in ("n_passages", "repeat_bytes", "removed_bytes")), F.coalesce("passages", F.lit("")).alias("passages"), F.coalesce("removed", F.lit("")).alias("removed"), F.coalesce("first_docs", F.array().cast("array<bigint>")).alias("first_docs"))
