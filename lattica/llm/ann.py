"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised
residuals, asymmetric distance tables, and exact reranking.

Centroids and codebooks are fitted on the driver on a bounded sample (SAMPLE vectors of least
hash); every vector is indexed. Equal vectors form a class that is indexed once with its KEEP
least ids, as no answer needs more of them; so a vector that a third of all rows hold is one
entry. How many of the nearest lists a query probes is measured: TRIALS query vectors of least hash are searched
exactly over all vectors (one pass, in blocks), and so many lists are probed that RECALL of their true neighbours lie in
them, and as many as hold SHORTLIST entries. Data without clusters need most lists, others few. Entries are dealt by hash into blocks of bounded size, whatever their list, and a
block is scanned for a bounded number of queries at a time; the SHORTLIST nearest by table are
reranked by the exact cosine in double precision.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite numbers take no part, nor do rows with a null vec_id; ties go to the smaller vec_id;
rows that repeat a vec_id with the same vector count once; with fewer candidates than k, all are
returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, MOST_LISTS, SUBSPACES, CODES, SHORTLIST = 16_384, 1024, 16, 256, 256
TRIALS, RECALL = 256, 0.97
ENTRY_BLOCK, LEAST_BLOCKS, QUERY_BLOCK = 65_536, 16, 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from random rows; an emptied cluster takes a random row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(near, x[:, j], k) / np.maximum(count, 1)
        empty = np.flatnonzero(count == 0)
        c[empty] = x[rng.integers(0, len(x), len(empty))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int64), (c * c).sum(axis=1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - x[at : at + 4096] @ c.T).argmin(axis=1)
    return out


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Coarse centroids and residual codebooks; everything that workers get by broadcast:
    at most MOST_LISTS centroids and SUBSPACES * CODES codewords."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = kmeans(sample, lists)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))]
        self.books = [kmeans(rest[:, p], CODES, 6, seed=2 + i) for i, p in enumerate(self.parts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        return own, np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def offsets(self) -> np.ndarray:
        """(lists, subspaces, codes): |b|^2 + 2 c.b of the codewords b under each list's centroid c."""
        out = np.zeros((len(self.centroids), len(self.parts), CODES), np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, i, : len(b)] = (b * b).sum(axis=1) + 2 * (self.centroids[:, p] @ b.T)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, subspaces, codes): -2 q.b. With |q - c|^2 and the offsets this adds up to the
        squared distance of the query's residual to the codewords, with one table for all lists."""
        out = np.zeros((len(queries), len(self.parts), CODES), np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, i, : len(b)] = -2 * (queries[:, p] @ b.T)
        return out


def classes(embeddings: DataFrame, keep: int) -> DataFrame:
    """h1, h2 (digest of a vector), v, ids: its least `keep` vec_ids."""
    v = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(17), v).alias("h2"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (sizes[0].n if sizes else 0))
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    least = rows.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("place", first).where(F.col("place") <= keep)
    return least.groupBy("h1", "h2").agg(F.min_by("v", "place").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def needed_probes(index, built: Index, every_class: DataFrame, trials: list, k: int) -> int:
    """The nearest lists that hold RECALL of the k true neighbours of the trial vectors (h1, h2, v)."""
    asked, own = unit([t.v for t in trials]), {(t.h1, t.h2): n for n, t in enumerate(trials)}
    shared = every_class.sparkSession.sparkContext.broadcast((asked, own))

    def run(batches):
        x, mine = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            u = unit(list(pdf["v"]))
            score = u @ x.T
            for row, key in enumerate(zip(pdf["h1"], pdf["h2"])):
                if key in mine:
                    score[row, mine[key]] = -2  # the trial vector itself
            top = np.argsort(-score, axis=0, kind="stable")[:k]
            trial = np.tile(np.arange(len(x)), len(top))
            lists = nearest(u, index.value.centroids)[top.ravel()]
            yield pd.DataFrame({"trial": trial.astype(np.int32), "score": score[top.ravel(), trial], "list": lists.astype(np.int32)})

    found = every_class.select("h1", "h2", "v").mapInPandas(run, "trial int, score double, list int").where("score > -2")
    place = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "list"))
    best = found.withColumn("place", place).where(F.col("place") <= k).select("trial", "list").collect()
    if not best:
        return len(built.centroids)
    c = built.centroids
    order = np.argsort((c * c).sum(axis=1) / 2 - asked @ c.T, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)[[r.trial for r in best], [r.list for r in best]]
    return int(np.sort(rank)[min(len(rank) - 1, math.ceil(RECALL * len(rank)) - 1)]) + 1


def _scan(index):
    def run(key, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return pd.DataFrame({"q1": [], "q2": [], "h1": [], "h2": [], "distance": []})
        entries = entries.sort_values(["list", "rep", "h1", "h2"], kind="stable")
        own = entries["list"].to_numpy()
        codes = np.frombuffer(b"".join(entries["code"]), np.uint8).reshape(len(entries), -1)
        c, at_part = index.value.centroids, np.arange(codes.shape[1])
        offset = np.zeros(len(codes), np.float32)
        table = index.value.offsets()
        for i in at_part:
            offset += table[own, i, codes[:, i]]
        flat = codes.astype(np.int32) + at_part.astype(np.int32) * CODES
        x, out = unit(list(queries["v"])), []
        h1, h2, q1, q2 = (f.to_numpy() for f in (entries["h1"], entries["h2"], queries["q1"], queries["q2"]))
        probed = np.unpackbits(np.frombuffer(b"".join(queries["lists"]), np.uint8).reshape(len(x), -1), axis=1).astype(bool)
        for at in range(0, len(x), 64):
            tables = index.value.tables(x[at : at + 64])
            coarse = ((x[at : at + 64, None, :] - c[None]) ** 2).sum(axis=2).astype(np.float32)
            for n in range(len(tables)):
                here = np.flatnonzero(probed[at + n][own])
                distance = coarse[n][own[here]] + offset[here] + tables[n].ravel()[flat[here]].sum(axis=1)
                order = np.argsort(distance, kind="stable")[:SHORTLIST]
                here = here[order]
                out.append(pd.DataFrame({"q1": np.full(len(here), q1[at + n]), "q2": np.full(len(here), q2[at + n]), "h1": h1[here], "h2": h2[here], "distance": distance[order].astype(np.float64)}))
        return pd.concat(out)

    return run


def _exact(batches):
    for pdf in batches:
        if len(pdf):
            score = (unit(list(pdf["v"])) * unit(list(pdf["qv"]))).sum(axis=1)
            yield pd.DataFrame({"q1": pdf["q1"], "q2": pdf["q2"], "score": np.clip(score, -1.0, 1.0), "ids": pdf["ids"]})


def nearest_neighbours(embeddings: DataFrame, k: int = 5, every: int = 50, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, its k nearest others."""
    spark = embeddings.sparkSession
    every_class = written(classes(embeddings, k + 1), "vector-classes")
    out = "query_id long, rank int, vec_id long, score double"
    n = every_class.count()
    if not n:
        return spark.createDataFrame([], out)
    share = min(1.0, SAMPLE / n)
    sample = every_class.where(F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("h1", "h2").limit(2 * SAMPLE).select("v")
    lists = max(1, min(MOST_LISTS, round(n**0.5)))
    built = Index(unit([r.v for r in sample.collect()] or [r.v for r in every_class.select("v").limit(1).collect()]), lists)
    index = spark.sparkContext.broadcast(built)

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                own, codes = index.value.encode(unit(list(pdf["v"])))
                yield pd.DataFrame({"list": own.astype(np.int32), "rep": [i[0] for i in pdf["ids"]], "h1": pdf["h1"], "h2": pdf["h2"], "code": [c.tobytes() for c in codes]})

    entries = written(every_class.mapInPandas(encode, "list int, rep long, h1 long, h2 long, code binary"), "index")
    held = {r["list"]: r["count"] for r in entries.groupBy("list").count().collect()}
    blocks = max(LEAST_BLOCKS, -(-n // ENTRY_BLOCK))
    sizes = np.array([held.get(i, 0) for i in range(len(built.centroids))])

    is_query = F.pmod("vec_id", F.lit(every)) == 0
    asked = embeddings.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.xxhash64("embedding").alias("q1"), F.xxhash64(F.lit(17), F.col("embedding")).alias("q2")).distinct()
    queries = written(asked.select("q1", "q2").distinct().join(every_class.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "v"), ["q1", "q2"]), "query-classes")

    if probes is None:
        trials = queries.orderBy("q1", "q2").limit(TRIALS).select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "v").collect()
        probes = needed_probes(index, built, every_class, trials, k) if trials else 1

    def probe(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(list(pdf["v"]))
            c = index.value.centroids
            order = np.argsort((c * c).sum(axis=1) / 2 - x @ c.T, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            take = ((np.arange(len(c))[None, :] < probes) | (before < SHORTLIST)) & (sizes[order] > 0)
            chosen = np.zeros(take.shape, bool)
            np.put_along_axis(chosen, order, take, axis=1)
            yield pd.DataFrame({"q1": pdf["q1"], "q2": pdf["q2"], "v": pdf["v"], "own": order[:, 0].astype(np.int32), "lists": [r.tobytes() for r in np.packbits(chosen, axis=1)], "probed": [np.flatnonzero(r).astype(np.int32) for r in chosen]})

    kind = "float" if "float" in dict(every_class.dtypes)["v"] else "double"
    each = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    probed = written(queries.mapInPandas(probe, f"q1 long, q2 long, v array<{kind}>, own int, lists binary, probed array<int>"), "probes")
    # parts of at most QUERY_BLOCK queries: of several small lists, or of a share of a large one
    asking, first, share, at, room = {r["own"]: r["count"] for r in probed.groupBy("own").count().collect()}, {}, {}, 0, QUERY_BLOCK
    for own in sorted(asking):
        share[own] = -(-asking[own] // QUERY_BLOCK)
        if asking[own] > room:
            at, room = at + 1, QUERY_BLOCK
        first[own] = at
        at, room = (at, room - asking[own]) if share[own] == 1 else (at + share[own], QUERY_BLOCK)
    parts = F.broadcast(spark.createDataFrame([(own, first[own], share[own]) for own in first], "own int, first int, share int"))
    probed = written(probed.join(parts, "own").withColumn("part", (F.col("first") + F.pmod("q1", F.col("share"))).cast("int")).drop("own", "first", "share"), "probes")
    # an entry goes to the parts that probe its list, no others
    wanted = probed.select(F.col("part").alias("to"), F.explode("probed").alias("list")).distinct()
    placed = entries.withColumn("block", F.pmod(F.xxhash64("rep", "h1"), F.lit(blocks)).cast("int")).join(wanted, "list").withColumnRenamed("to", "part")
    probed = probed.drop("probed")
    scanned = placed.groupBy("block", "part").cogroup(probed.withColumn("block", each(blocks)).groupBy("block", "part")).applyInPandas(_scan(index), "q1 long, q2 long, h1 long, h2 long, distance double")
    place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy("distance", "h1", "h2"))
    short = scanned.withColumn("place", place).where(F.col("place") <= SHORTLIST).select("q1", "q2", "h1", "h2")
    both = short.join(every_class, ["h1", "h2"]).join(queries.withColumnRenamed("v", "qv"), ["q1", "q2"]).select("q1", "q2", "v", "qv", "ids")
    scored = both.mapInPandas(_exact, "q1 long, q2 long, score double, ids array<long>").select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id"))
    top = scored.withColumn("place", best).where(F.col("place") <= k + 1).groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    answered = asked.join(top, ["q1", "q2"]).select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return answered.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
