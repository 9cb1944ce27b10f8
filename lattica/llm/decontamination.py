"""Benchmark decontamination by latent semantic retrieval.

Items are the stated query set. They are handled in blocks of ITEMS (each block reads the
documents once), so what workers get by broadcast is bounded: an item block's vocabulary, its
inverse document frequencies and a basis of at most FEATURES x RANK numbers.

1. Each whole text becomes the numbers of its words in the block's vocabulary, written once; document
   frequencies are counted over all documents.
2. A randomised SVD of the TF-IDF rows (by the root of the inverse document frequency) of the items and of every passage of
   PASSAGE words of every document gives the basis, which is the index of the search: partitions apply the range finder
   to their own rows, in dense blocks of few passages, and the small matrices are added up by ranges of features.
3. Every passage of every document (overlapping windows of each width in WIDTHS, a step of STEP words) is
   folded into the basis, and its cosine with every item of about that length is taken, in blocks. Items with
   COSINE or more are its candidates. Only what can't be confirmed is left out, by a proved bound, for segments
   and then for passages, each with its surroundings: a common subsequence is no longer than the words, with their
   numbers, that these and the item share.
   Besides, common stretches of RUN words are looked up by hash.
4. Candidates are confirmed on words: a longest common subsequence of at least LCS of the
   item's words within the passage and its surroundings; or of LCS_ANSWER if the item's
   answer (its last sentence) is there to the same degree; or RUN words in one stretch.

`cosine` is that of the folded passage and the folded item, from -1 to 1. For the search a passage's length is taken
as at least that of its whole TF-IDF weight (with words outside of the vocabulary as ones of median weight), since a
passage of which little lies in the basis tells little by its direction.

Defined results: a null or empty text, and an item without words, match nothing; rows that
repeat a doc_id give the pairs of either once; a null doc_id or item_id is left out; without
items or documents there are no pairs; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import compress, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task_memo, written

ITEMS, FEATURES, RANK, OVERSAMPLE = 1024, 1 << 16, 128, 8
#: Words of a passage that the basis is fitted on, and features of a matrix that are added up in one piece.
PASSAGE, PIECE = 32, 64
STEP, WIDTHS, COSINE = 8, (24, 40, 64), 0.3
LCS, LCS_ANSWER, RUN = 0.6, 0.5, 13
#: Words of texts that are searched at a time, words of a segment (at least; a multiple of STEP), and pairs of segments
#: and items' words that are compared at a time.
GROUP, SEGMENT, PAIRS = 1 << 12, 128, 1 << 18
WORD = re.compile(r"\w+")
#: The characters of Latin-1, each of which is one byte and stays one when lower-cased: that of a word lower-cased, else a space.
LATIN = bytes(ord(chr(c).lower()) if WORD.match(chr(c).lower()) else 32 for c in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def latin(text: str) -> bytes | None:
    """The text in Latin-1, if it has no other characters."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence by bit rows of b."""
    places: dict[int, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        here = places.get(x)
        if here:
            u = row & here
            row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def longest_run(a: list[int], b: list[int]) -> int:
    """Longest common stretch."""
    best, before, at = 0, {}, {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    for x in a:
        now = {j: before.get(j - 1, 0) + 1 for j in at.get(x, ())}
        best = max(best, max(now.values(), default=0))
        before = now
    return best


def run_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of each stretch of RUN numbers."""
    n, out = len(ids) - RUN + 1, np.zeros(max(0, len(ids) - RUN + 1), np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    for i in range(RUN if n > 0 else 0):
        out = out * BASE + x[i : i + n]
    return out


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range behind the other."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


class Items:
    """A block of items over its own vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        texts = [words_of(t) for _, t in rows]
        self.vocab = {w: n for n, w in enumerate(sorted({w for t in texts for w in t}))}
        self.latin = {b: n for w, n in self.vocab.items() if (b := latin(w)) is not None}
        self.words = [[self.vocab[w] for w in t] for t in texts]
        self.answers = [[self.vocab[w] for w in words_of([s for s in SENTENCE.split(t.strip()) if words_of(s)][-1])] for _, t in rows]
        self.width = min(len(self.vocab), FEATURES)
        self.sizes = np.array([len(w) for w in self.words])
        self.needed = np.ceil(LCS_ANSWER * self.sizes - 1e-9).astype(np.int64)
        self.counts = [Counter(w) for w in self.words]
        pairs = [(x, i, c) for i, own in enumerate(self.counts) for x, c in own.items()]
        pairs.sort()
        word, self.owner, self.number = (np.array(c, np.int64) for c in zip(*pairs))
        self.owner_at = np.searchsorted(word, np.arange(len(self.vocab) + 1))
        self.runs: dict[int, set[int]] = {}
        for i, w in enumerate(self.words):
            for h in run_hashes(np.array(w, np.int64)).tolist():
                self.runs.setdefault(h, set()).add(i)
        self.run_table = np.array(sorted(self.runs), np.uint64)
        # for each width the items that a window of it covers well
        near = [(self.sizes > w * 0.55) & (self.sizes <= w * 1.1) for w in WIDTHS]
        near[0] |= self.sizes <= WIDTHS[0]
        near[-1] |= self.sizes > WIDTHS[-1]
        self.of_width = near

    def numbers(self, text: str | None) -> np.ndarray:
        """The words' numbers, the size of the vocabulary for other words."""
        data = latin(text or "")
        words, known = (words_of(text), self.vocab) if data is None else (data.translate(LATIN).split(), self.latin)
        return np.fromiter(map(known.get, words, repeat(len(self.vocab))), np.int64, len(words))

    def kind(self) -> type:
        return np.uint16 if len(self.vocab) < 1 << 16 else np.uint32

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.idf = np.sqrt(np.log((n + 1) / (df + 1)) + 0.01).astype(np.float32)

    def rows(self, passage: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, TF-IDF weight) of passages, each of length 1, from words with their passages' numbers. Rows
        are counted from 0; a passage without words has none."""
        key, count = np.unique(passage * len(self.vocab) + ids, return_counts=True)
        own, x = np.divmod(key, len(self.vocab))
        row = np.cumsum(np.diff(own, prepend=own[:1]) != 0)
        v = count * self.idf[x]
        return row, x % self.width, (v / np.sqrt(np.bincount(row, v * v))[row]).astype(np.float32)

    def row(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features and TF-IDF weights, of length 1, of a passage."""
        return self.rows(np.zeros(len(ids), np.int64), ids)[1:]

    def add_applied(self, passage: np.ndarray, ids: np.ndarray, q: np.ndarray, out: np.ndarray) -> int:
        """Add A^T A q for the TF-IDF rows of passages to out; the number of rows."""
        if not len(ids):
            return 0
        row, x, v = self.rows(passage, ids)
        features, column = np.unique(x, return_inverse=True)
        a = np.zeros((int(row[-1]) + 1, len(features)), np.float32)
        np.add.at(a.reshape(-1), row * len(features) + column, v)
        out[features] += a.T @ (a @ q[features])
        return len(a)

    def use_basis(self, basis: np.ndarray) -> None:
        """Fold the items into the latent space."""
        self.folded = np.zeros((len(self.vocab) + 2, basis.shape[1]), np.float32)  # the last two: words outside, no word
        self.folded[:-2] = basis[np.arange(len(self.vocab)) % self.width] * self.idf[:, None]
        x = np.stack([self.folded[w].sum(axis=0) for w in self.words])
        self.latent = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.weight2 = np.append(self.idf.astype(np.float64) ** 2, [float(np.median(self.idf)) ** 2, 0.0])  # last: no word

    def possible(self, texts: list[np.ndarray]) -> tuple[int, list[np.ndarray]]:
        """Words of a segment, and for each text (segment, item): whether a passage that begins in the segment can have
        enough of the item's words with its surroundings. Segments are at least as long as the longest item, so a word is
        in the reach of few."""
        around = int(self.sizes.max())
        length = max(SEGMENT, -(-around // STEP) * STEP)
        sizes = np.array([len(t) for t in texts])
        count = -(-sizes // length)
        end = np.cumsum(sizes)
        text = np.repeat(np.arange(len(texts)), count)
        begin = (end - sizes)[text] + (np.arange(len(text)) - (np.cumsum(count) - count)[text]) * length
        lo, hi = np.maximum(begin - around, (end - sizes)[text]), np.minimum(begin + length + WIDTHS[-1] + around, end[text])
        words, out = np.concatenate(texts), np.zeros((len(text), len(self.ids)), bool)
        step = max(1, PAIRS // len(self.owner))
        for s in range(0, len(text), step):
            part = slice(s, s + step)
            n = hi[part] - lo[part]
            x = words[_ranges(lo[part], n)]
            on = x < len(self.vocab)
            segment, x = np.divmod(np.unique(np.repeat(np.arange(len(n)) * len(self.vocab), n)[on] + x[on]), len(self.vocab))
            owners = self.owner_at[x + 1] - self.owner_at[x]
            at = _ranges(self.owner_at[x], owners)
            cell = np.repeat(segment * len(self.ids), owners) + self.owner[at]
            out[part] = np.bincount(cell, self.number[at], len(n) * len(self.ids)).reshape(len(n), -1) >= self.needed
        return length, np.split(out, np.cumsum(count)[:-1])

    def near(self, texts: list[np.ndarray], length: int, possible: list[np.ndarray]):
        """(text, [(item, lo, hi)]), by items: passages of each text with a cosine of COSINE or more with one of the items
        that are possible in the passage's segment of that length. The texts lie one behind the other, each from the
        beginning of a block of STEP words on; no passage reaches into the next."""
        sizes = np.array([len(t) for t in texts])
        count = -(-sizes // STEP)
        begin = np.cumsum(count) - count
        total = int(count.sum())
        ids = np.full(total * STEP, len(self.vocab) + 1, np.int64)
        for n, t in enumerate(texts):
            ids[begin[n] * STEP : begin[n] * STEP + len(t)] = t
        allowed = np.concatenate(possible)
        upto = np.zeros((total + 1, self.folded.shape[1]), np.float32)
        for column in ids.reshape(total, STEP).T:
            upto[1:] += self.folded[column]
        np.cumsum(upto, axis=0, out=upto)
        weight = np.concatenate([[0], np.cumsum(self.weight2[ids].reshape(total, STEP).sum(axis=1))])
        text = np.repeat(np.arange(len(texts)), count)
        start, end, some = begin[text], (begin + count)[text], allowed.any(axis=0)
        before = np.cumsum([len(a) for a in possible]) - [len(a) for a in possible]
        segment = before[text] + (np.arange(total) - start) * STEP // length
        found = [np.zeros((4, 0), np.int64)]
        for width, fits in zip(WIDTHS, self.of_width):
            own = np.flatnonzero(fits & some)
            if not len(own):
                continue
            lo = np.flatnonzero((np.arange(total) + width // STEP <= end) | (np.arange(total) == start))
            hi = np.minimum(lo + width // STEP, end[lo])
            p = upto[hi] - upto[lo]
            norm = np.sqrt(np.maximum(weight[hi] - weight[lo], np.einsum("ij,ij->i", p, p)))
            at, item = np.nonzero((p @ self.latent[own].T >= (COSINE * norm)[:, None]) & allowed[np.ix_(segment[lo], own)])
            n = text[lo[at]]
            found.append(np.stack([n, own[item], (lo[at] - begin[n]) * STEP, np.minimum((hi[at] - begin[n]) * STEP, sizes[n])]))
        rows = np.concatenate(found, axis=1)
        rows = rows[:, np.lexsort(rows[1::-1])].T.tolist()
        for n, own in groupby(rows, itemgetter(0)):
            yield n, [(i, lo, hi) for _, i, lo, hi in own]

    def stretches(self, ids: np.ndarray):
        """(item, lo, hi): stretches of RUN words that an item has as well."""
        if len(ids) < RUN or not len(self.run_table):
            return
        known = np.concatenate([[0], np.cumsum(ids < len(self.vocab))])
        at = np.flatnonzero(known[RUN:] - known[:-RUN] == RUN)
        if len(at):
            hashes = run_hashes(ids)[at]
            found = self.run_table[np.minimum(np.searchsorted(self.run_table, hashes), len(self.run_table) - 1)] == hashes
            for place, h in zip(at[found].tolist(), hashes[found].tolist()):
                for i in self.runs[h]:
                    yield i, place, place + RUN

    def cosine(self, ids: np.ndarray, item: int) -> float:
        own = ids[ids < len(self.vocab)]
        p = self.folded[own].sum(axis=0, dtype=np.float64)
        return float(np.clip(p @ self.latent[item] / max(np.linalg.norm(p), 1e-9), -1, 1))

    def confirmed(self, ids: list[int], i: int, lo: int, hi: int, stretch: bool) -> tuple[float, bool] | None:
        """(share of the item's words in order, answer there) of a passage and its surroundings; None if
        that is no leak. stretch: the passage is a common stretch of RUN words."""
        item, size, own = self.words[i], len(self.words[i]), self.counts[i]
        around = [x for x in ids[max(0, lo - size) : hi + size] if x in own]
        if sum(map(own.__getitem__, set(around))) < self.needed[i] and not stretch:
            return None
        common = lcs_length(around, item)
        if common < self.needed[i] and not stretch:
            return None
        share = common / size
        answer = share >= LCS_ANSWER and lcs_length(around, self.answers[i]) >= LCS * len(self.answers[i])
        return (share, answer) if share >= LCS or answer or stretch else None

    def thinned(self, found) -> list[tuple[int, int, int]]:
        """Passages of one item a step of half its size apart: a passage's surroundings, which are compared as well, hold
        those that are left out, with half of the item's size on either side."""
        out: list[tuple[int, int, int]] = []
        for i, lo, hi in sorted(found):
            if out and out[-1][0] == i and lo <= out[-1][1] + self.sizes[i] // 2 and hi <= out[-1][2] + self.sizes[i] // 2:
                continue
            out.append((i, lo, hi))
        return out

    def supported(self, ids: np.ndarray, found: list[tuple[int, int, int]]):
        """The passages, given by items, that have enough of the item's words with their surroundings: the first thing that
        confirmed asks for, of all passages of an item at once. Each different word of the item is a bit; of more than 64 some
        share one, which then counts as all of them."""
        bit = np.zeros(len(self.vocab) + 2, np.uint64)
        for i, own in groupby(found, itemgetter(0)):
            own, size = list(own), len(self.words[i])
            words = np.fromiter(self.counts[i], np.int64, len(self.counts[i]))
            place = np.arange(len(words)) % 64
            bit[words] = np.uint64(1) << place.astype(np.uint64)
            weight = np.bincount(place, np.fromiter(self.counts[i].values(), np.int64, len(words)))
            ends = np.array(own)[:, 1:]
            ends[:, 0] = np.maximum(ends[:, 0] - size, 0)
            ends[:, 1] = np.minimum(ends[:, 1] + size, len(ids))
            first, last = int(ends[:, 0].min()), int(ends[:, 1].max())
            near = np.zeros(last - first + 1, np.uint64)
            near[:-1] = bit[ids[first:last]]
            there = np.bitwise_or.reduceat(near, (ends - first).reshape(-1))[::2]
            bit[words] = 0
            most = (there[:, None] >> np.arange(len(weight), dtype=np.uint64) & np.uint64(1)).astype(np.float64) @ weight
            yield from compress(own, (most >= self.needed[i]).tolist())

    def matches(self, texts: list[np.ndarray]) -> list[dict[int, tuple[float, float, bool, int]]]:
        """For each text: item number -> (cosine, share of its words in order, answer there, longest stretch)."""
        texts = [t.astype(np.int64) for t in texts]
        found: list[list] = [[(*x, True) for x in self.thinned(self.stretches(t))] for t in texts]
        length, possible = self.possible(texts) if texts else (SEGMENT, [])
        held: list[int] = []
        for n, t in enumerate(texts):
            if possible[n].any():
                held.append(n)
            if held and (n + 1 == len(texts) or sum(len(texts[m]) for m in held) >= GROUP):
                for m, own in self.near([texts[m] for m in held], length, [possible[m] for m in held]):
                    found[held[m]] += [(*x, False) for x in self.thinned(self.supported(texts[held[m]], own))]
                held = []
        return [self._best(t, own) if own else {} for t, own in zip(texts, found)]

    def _best(self, ids: np.ndarray, found: list) -> dict[int, tuple[float, float, bool, int]]:
        best: dict[int, tuple] = {}
        listed = ids.tolist()
        for i, lo, hi, stretch in found:
            new = self.confirmed(listed, i, lo, hi, stretch)
            if new and (i not in best or new[0] >= best[i][0]):
                new = (new[0], self.cosine(ids[lo:hi], i), new[1], lo, hi)
                if i not in best or new > best[i]:
                    best[i] = new
        around = lambda i, lo, hi: listed[max(0, lo - len(self.words[i])) : hi + len(self.words[i])]
        return {i: (cosine, share, answer, longest_run(around(i, lo, hi), self.words[i])) for i, (share, cosine, answer, lo, hi) in best.items()}


def _numbered(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, ids: the words' numbers of every document that has words, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        it = shared.value
        kind = it.kind()
        for batch in batches:
            ids = [it.numbers(t).astype(kind).tobytes() if t else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return written(docs.mapInArrow(task_memo(run), "doc_id long, ids binary").where(F.length("ids") > 0), "word-numbers")


def _document_counts(numbered: DataFrame, items: Items) -> np.ndarray:
    size, kind = len(items.vocab), items.kind()

    def run(batches):
        for batch in batches:
            count, last = np.zeros(size + 1, np.int64), np.full(size + 1, -1)
            for n, ids in enumerate(batch.column(0).to_pylist()):
                x = np.frombuffer(ids, kind)
                last[x] = n
                seen = x[last[x] == n]
                count[np.unique(seen)] += 1
            seen = np.flatnonzero(count[:size])
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(count[seen], pa.int64())], ["term", "n"])

    df = np.zeros(size, np.float64)
    for r in numbered.select("ids").mapInArrow(task_memo(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    return df


def _blocks(texts: list[np.ndarray]):
    """(passages' numbers, words) of all passages of texts, about GROUP words at a time: a block ends with a passage,
    so a long text makes several, and has at most 2 * GROUP / PASSAGE passages."""
    held: list[np.ndarray] = []
    count = 0
    for t in texts:
        for i in range(0, len(t), GROUP):
            held.append(t[i : i + GROUP])
            count += -(-len(held[-1]) // PASSAGE)
            if count * PASSAGE >= GROUP:
                yield _passages(held)
                held, count = [], 0
    if held:
        yield _passages(held)


def _passages(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    count = -(-sizes // PASSAGE)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(np.cumsum(count) - count, sizes) + place // PASSAGE, np.concatenate(texts).astype(np.int64)


def _fit_basis(numbered: DataFrame, items: Items, rows: int) -> np.ndarray:
    """The leading right singular vectors, by a randomised range finder with one power round."""
    spark, kind = numbered.sparkSession, items.kind()

    def product(q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float32)
        shared = spark.sparkContext.broadcast((items, q))

        def run(batches):
            it, matrix = shared.value
            out, unknown, n = np.zeros(matrix.shape), len(it.vocab), 0
            for batch in batches:
                for passage, ids in _blocks([np.frombuffer(data, kind) for data in batch.column(0).to_pylist()]):
                    known = ids < unknown
                    n += it.add_applied(passage[known], ids[known], matrix, out)
            at = range(0, len(out) if n else 0, PIECE)
            pieces = [out[i : i + PIECE].astype(np.float32).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([n] * len(at), pa.int64()), pa.array(pieces, pa.binary())], ["at", "n", "m"])

        def summed(batches):
            width = shared.value[1].shape[1]
            out: dict[int, list] = {}
            for batch in batches:
                for i, n, m in zip(*(c.to_pylist() for c in batch.columns)):
                    own = out.setdefault(i, [0, 0.0])
                    own[0] += n
                    own[1] = own[1] + np.frombuffer(m, np.float32).reshape(-1, width).astype(np.float64)
            pieces = [m.astype(np.float32).tobytes() for _, m in out.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([n for n, _ in out.values()], pa.int64()), pa.array(pieces, pa.binary())], ["at", "n", "m"])

        total, passages = np.zeros(q.shape), 0
        if rows:
            schema = "at int, n long, m binary"
            for r in numbered.select("ids").mapInArrow(task_memo(run), schema).repartition("at").mapInArrow(task_memo(summed), schema).collect():
                m = np.frombuffer(r.m, np.float32).reshape(-1, q.shape[1])
                total[r.at : r.at + len(m)] += m
                passages = r.n
        # the items weigh as much as all passages, so that the basis holds their terms
        own = np.zeros(q.shape)
        for i in range(0, len(items.words), GROUP // PASSAGE):
            some = items.words[i : i + GROUP // PASSAGE]
            items.add_applied(np.repeat(np.arange(len(some)), [len(w) for w in some]), np.concatenate(some), q, own)
        return total + own * max(1.0, passages / len(items.words))

    rank = min(RANK, items.width)
    width = min(rank + OVERSAMPLE, items.width)
    q, _ = np.linalg.qr(product(np.random.default_rng(5).normal(size=(items.width, width))))
    image = product(q)
    values, vectors = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    top = np.argsort(-values)[:rank]
    return (q @ vectors[:, top]).astype(np.float32)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs (share of the item's words in order), answer, longest_run."""
    schema = "doc_id long, item_id long, cosine double, lcs double, answer boolean, longest_run int"
    spark = docs.sparkSession
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sound = benchmark.where(F.col("item_id").isNotNull() & F.col("text").rlike(r"\w")).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-sound.count() // ITEMS)
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = sorted((r.item_id, r.text) for r in sound.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect() if words_of(r.text))
        if not rows:
            continue
        items = Items(rows)
        numbered = _numbered(keyed, items)
        n = numbered.count()
        items.weigh(_document_counts(numbered, items), n)
        items.use_basis(_fit_basis(numbered, items, n))
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            it = shared.value
            kind = it.kind()
            for batch in batches:
                matches = it.matches([np.frombuffer(ids, kind) for ids in batch.column(1).to_pylist()])
                out = [(d, it.ids[i], c, s, a, r) for d, own in zip(batch.column(0).to_pylist(), matches) for i, (c, s, a, r) in own.items()]
                columns = list(zip(*out)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int32()))], ["doc_id", "item_id", "cosine", "lcs", "answer", "longest_run"])

        found = found.unionAll(numbered.mapInArrow(task_memo(run), schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.max("longest_run").alias("longest_run"))
