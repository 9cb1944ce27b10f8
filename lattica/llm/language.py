"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in lower case in UTF-8. One gated layer runs forwards and one backwards, each with
an update gate; every byte gets a distribution over the languages from both states. A document's
distribution is the mean over the bytes of its letters (of a-z and of all characters beyond
ASCII); other bytes are labelled and carry the state on, but are not pooled, as digits and signs are of no language. The state runs on
over words and whole segments: a text is cut into segments of SEGMENT bytes, at the beginning of a
character, and each is read with CONTEXT bytes more on either side, which give it state and are not pooled.

The network is trained on the driver by backpropagation through time in numpy, on a bounded sample of
labelled rows outside the held-out fold: for each language the documents of least hash in up to
SAMPLE_DOCS hash classes (fewer beyond SAMPLE_ALL / SAMPLE_DOCS languages; more than SAMPLE_ALL languages
raise an error, none is dropped), SAMPLE_CHARS characters of each from a place set by its hash. Every language has the same weight.
Prediction reads whole texts.

Defined results: `und` with score 0 for a null text, a text without a letter, or if there is
nothing to learn from; a null doc_id counts as the empty text for the folds; repeated rows
give a row each; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import task_memo

FOLDS = 5
SAMPLE_ALL, SAMPLE_DOCS, SAMPLE_CHARS = 8192, 128, 4000
SEGMENT, CONTEXT, HIDDEN, ROWS = 480, 16, 8, 384
TRAIN_BYTES, TRAIN_ROWS, TRAIN_STEPS = 64, 256, 400
LETTER = regex.compile(r"\p{L}")
POOLED = np.array([b >= 0x80 or 97 <= b <= 122 for b in range(256)])
#: Byte 0 is padding: its gate is shut, so a state passes it unchanged.
SHUT = -30.0


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that is never learned from: crc32 of the id's text mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def bytes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    return np.where(data == 0, 32, data).astype(np.uint8)


def segments(data: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(from, first, end, to): the segment first..end and its surroundings from..to, all at beginnings of characters."""
    lead = data & 0xC0 != 0x80
    cuts = [0]
    while len(data) - cuts[-1] > SEGMENT:
        at = cuts[-1] + SEGMENT
        back = np.flatnonzero(lead[at - 3 : at + 1])
        cuts.append(at - 3 + int(back[-1]) if len(back) else at)
    cuts.append(len(data))
    return [(max(0, a - CONTEXT), a, b, min(len(data), b + CONTEXT)) for a, b in zip(cuts[:-1], cuts[1:])]


class ByteNet:
    """xz, xc: by byte, what goes into the gate and the candidate state; uz, uc: what the state before does;
    f and b: the two directions; out and bias: from both states to the labels."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        self.labels, self.hidden = labels, hidden
        rng, h = np.random.default_rng(seed), hidden
        shape = {f"{k}{d}": (256, h) if k[0] == "x" else (h, h) for d in "fb" for k in ("xz", "xc", "uz", "uc")} | {"outf": (h, len(labels)), "outb": (h, len(labels)), "bias": (1, len(labels))}
        self.w = {k: rng.normal(0, 0.5 if k[0] == "x" else h**-0.5, s).astype(np.float32) for k, s in shape.items()}
        for d in "fb":
            self.w["xz" + d] -= 1
            self.w["xz" + d][0] = SHUT

    def states(self, d: str, data: np.ndarray) -> np.ndarray:
        """States after each byte; data has a row for each place, a column for each text."""
        w, (width, n) = self.w, data.shape
        kind = w["uz" + d].dtype
        xz, xc, uz, uc = w["xz" + d] / 2, w["xc" + d], w["uz" + d] / 2, w["uc" + d]
        out, s = np.empty((width, n, self.hidden), kind), np.zeros((n, self.hidden), kind)
        z, c, rec = np.empty_like(s), np.empty_like(s), np.empty_like(s)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            np.take(xz, data[t], axis=0, out=z)
            np.take(xc, data[t], axis=0, out=c)
            z += np.matmul(s, uz, out=rec)
            c += np.matmul(s, uc, out=rec)
            np.tanh(z, out=z)
            np.tanh(c, out=c)
            z *= 0.5
            z += 0.5
            c -= s
            c *= z
            s = np.add(s, c, out=out[t])
        return out

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(places, texts, labels)"""
        w, ahead, back = self.w, self.states("f", data), self.states("b", data)
        e = ahead.reshape(-1, self.hidden) @ w["outf"]
        e += back.reshape(-1, self.hidden) @ w["outb"]
        e += w["bias"]
        np.exp(np.minimum(e, 60, out=e), out=e)
        e /= e @ np.ones((len(self.labels), 1), e.dtype)
        return e.reshape(*data.shape, -1)

    def _back(self, grads: dict, d: str, data: np.ndarray, states: np.ndarray, given: np.ndarray) -> None:
        w, (width, n) = self.w, data.shape
        xz, xc, uz, uc = (w[k + d] for k in ("xz", "xc", "uz", "uc"))
        carry, none = np.zeros_like(given[0]), np.zeros_like(given[0])
        order = range(width - 1, -1, -1) if d == "f" else range(width)
        for t in order:
            before = t - 1 if d == "f" else t + 1
            s = states[before] if 0 <= before < width else none
            z = 1 / (1 + np.exp(-(xz[data[t]] + s @ uz)))
            c = np.tanh(xc[data[t]] + s @ uc)
            g = carry + given[t]
            gz, gc = g * (c - s) * z * (1 - z), g * z * (1 - c * c)
            carry = g * (1 - z) + gz @ uz.T + gc @ uc.T
            grads["uz" + d] += s.T @ gz
            grads["uc" + d] += s.T @ gc
            seen = np.zeros((256, n), g.dtype)
            seen[data[t], np.arange(n)] = 1
            grads["xz" + d] += seen @ gz
            grads["xc" + d] += seen @ gc
        grads["xz" + d][0] = grads["xc" + d][0] = 0

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the pooled bytes, and its gradients by backpropagation through time; target
        has a label for each byte."""
        w = self.w
        states = {d: self.states(d, data) for d in "fb"}
        logits = states["f"] @ w["outf"] + states["b"] @ w["outb"] + w["bias"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        mask = POOLED[data].astype(p.dtype)
        total, at = max(1.0, float(mask.sum())), target[:, :, None]
        loss = -float((np.log(np.take_along_axis(p, at, 2)[:, :, 0] + 1e-9) * mask).sum() / total)
        np.put_along_axis(p, at, np.take_along_axis(p, at, 2) - 1, 2)
        p *= (mask / total)[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["bias"] = p.sum(axis=(0, 1))[None, :]
        for d in "fb":
            grads["out" + d] = np.tensordot(states[d], p, axes=([0, 1], [0, 1]))
            self._back(grads, d, data, states[d], p @ w["out" + d].T)
        return loss, grads

    def fit(self, texts: list[list[np.ndarray]], steps: int = TRAIN_STEPS, rows: int = TRAIN_ROWS, rate: float = 0.03, seed: int = 11) -> list[float]:
        """Adam over random stretches of texts[label], of 8 to TRAIN_BYTES bytes. Half of the rows go over from one
        label's stretch to another's, and some bytes are replaced by ones that are of no letter, so that the state neither sticks
        to its first label nor is led astray by signs that the sample lacks."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(x) for k, x in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        weights = [np.array([len(t) for t in own], float) for own in texts]
        weights = [x / x.sum() for x in weights]
        signs = np.flatnonzero(~POOLED)[1:].astype(np.uint8)
        for step in range(1, steps + 1):
            data, target = np.zeros((TRAIN_BYTES, rows), np.uint8), np.zeros((TRAIN_BYTES, rows), np.int64)
            for i in range(rows):
                end, sizes = 0, rng.integers(8, TRAIN_BYTES + 1, 2) if i % 2 else rng.integers(8, TRAIN_BYTES // 2 + 1, 2)
                for size in sizes[: 2 - i % 2]:
                    label = int(rng.integers(0, len(texts)))
                    own = texts[label][rng.choice(len(texts[label]), p=weights[label])]
                    size = min(len(own), int(size))
                    at = int(rng.integers(0, len(own) - size + 1))
                    data[end : end + size, i] = own[at : at + size]
                    target[end : end + size, i] = label
                    end += size
            noise = (rng.random(data.shape) < 0.03) & (data > 0) & (data < 128)
            data[noise] = signs[rng.integers(0, len(signs), int(noise.sum()))]
            loss, grads = self.gradients(data, target)
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def distributions(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The mean distribution over the bytes of each text's letters; None without a letter."""
        sums = np.zeros((len(texts), len(self.labels)))
        counts = np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray, int, int]] = []

        def flush():
            held.sort(key=lambda x: -len(x[1]))
            for at in range(0, len(held), ROWS):
                some = held[at : at + ROWS]
                data, mask = np.zeros((len(some), len(some[0][1])), np.uint8), np.zeros((len(some), len(some[0][1])), bool)
                for i, (_, piece, a, b) in enumerate(some):
                    data[i, : len(piece)] = piece
                    mask[i, a:b] = POOLED[piece[a:b]]
                p = self.probabilities(np.ascontiguousarray(data.T))
                p *= mask.T[:, :, None]
                np.add.at(sums, [x[0] for x in some], p.sum(axis=0, dtype=np.float64))
                np.add.at(counts, [x[0] for x in some], mask.sum(axis=1))
            held.clear()

        for n, text in enumerate(texts):
            if text and LETTER.search(text):
                data = bytes_of(text)
                for start, a, b, end in segments(data):
                    held.append((n, data[start:end], a - start, b - start))
                    if len(held) >= 4 * ROWS:
                        flush()
        if held:
            flush()
        return [sums[n] / counts[n] if counts[n] else None for n in range(len(texts))]

    def positions(self, text: str) -> list[str]:
        """The label of every byte of the lower-cased text."""
        data, out = bytes_of(text), []
        for start, a, b, end in segments(data) if len(data) else ():
            p = self.probabilities(data[start:end, None])
            out += [self.labels[i] for i in p[a - start : b - start, 0].argmax(axis=1)]
        return out


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of a bounded sample of the labelled rows outside the held-out fold."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.select("lang").distinct().count()
    if n > SAMPLE_ALL:
        raise ValueError(f"{n} languages; the sample holds {SAMPLE_ALL} documents")
    if not n:
        return []
    h = F.xxhash64(F.col("doc_id"), F.lit(5))
    least = rows.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(min(SAMPLE_DOCS, SAMPLE_ALL // n))).alias("part")).agg(F.min(h).alias("h"))
    known = docs.sparkSession.createDataFrame(least.select("lang", "h").collect(), "s_lang string, s_h long")
    begin = (F.pmod(h, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1).cast("int")
    found = rows.select("lang", F.substr("text", begin, F.lit(SAMPLE_CHARS)).alias("text"), h.alias("h")).join(F.broadcast(known), (F.col("lang") == F.col("s_lang")) & (F.col("h") == F.col("s_h")), "left_semi")
    picked = found.groupBy("lang", "h").agg(F.min("text").alias("text"))  # rows that repeat a doc_id
    return sorted((r.lang, r.text) for r in picked.select("lang", "text").collect())


def train(docs: DataFrame) -> ByteNet | None:
    """A network for the languages of docs; None if there is nothing to learn from."""
    by_lang: dict[str, list[np.ndarray]] = {}
    for lang, text in sample(docs):
        if LETTER.search(text):
            by_lang.setdefault(lang, []).append(bytes_of(text))
    if not by_lang:
        return None
    labels = sorted(by_lang)
    net = ByteNet(labels)
    if len(labels) > 1:
        net.fit([by_lang[x] for x in labels])
    return net


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if net is None:
        return keyed.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        own = shared.value
        for batch in batches:
            labels, scores = [], []
            for p in own.distributions(batch.column(2).to_pylist()):
                best = -1 if p is None else int(p.argmax())
                labels.append("und" if p is None else own.labels[best])
                scores.append(0.0 if p is None else min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return keyed.mapInArrow(task_memo(run), "doc_id long, held_out boolean, lang_pred string, score double")


def label_documents(docs: DataFrame, least: float) -> DataFrame:
    """docs with lang as predicted, without the rows that are `und` or score under `least`."""
    net = train(docs)
    if net is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        own = shared.value
        for batch in batches:
            found = own.distributions(batch.column(text_at).to_pylist())
            keep = [p is not None and bool(p.max() >= least) for p in found]
            labels = [own.labels[int(p.argmax())] if k else None for p, k in zip(found, keep)]
            yield batch.set_column(lang_at, "lang", pa.array(labels, pa.string())).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task_memo(run), docs.schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
