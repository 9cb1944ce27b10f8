"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each whole text gives its set of word shingles, the set's size and digest, and a signature
   of COORDINATES minimum hashes. Equal sets form a class; its least doc_id stands for it, and
   with it the one text of that doc_id (by hash) whose set it is.
2. Representatives are posted under each coordinate-value pair. Two sets of similarity t agree
   in a coordinate with probability t; a pair counts if it agrees in MATCHES or more.
   Postings that nobody shares are skipped by a count by pair; who has fewer than MATCHES
   shared ones cannot match. Of the rest, ordered from the rarest, only the prefix of
   COORDINATES - MATCHES + 1 (unshared ones included) is merged: two signatures that
   agree in MATCHES coordinates must meet there. So long lists, as of common passages,
   are mostly skipped.
3. In a list, signatures are compared in blocks; links to a local root (not all pairs) come
   out. Their components are candidate clusters.
4. Each cluster's texts come together once. Exact intersections of the full sets are counted
   by a product of the incidence matrix of shared shingles; links that pass the exact
   threshold are united, and again only links to a local root come out. Lists and clusters
   above BLOCK members are dealt as pairs of blocks, so no task holds more than two blocks; a member of
   one of n members is copied n / BLOCK times, the price of losing no link between unlike sets.
5. The components of the confirmed links, with the classes, give each document its component.

With 32 coordinates and 17 matches, a pair at similarity 0.85 (0.8) is missed with a
probability below 1e-5 (3e-4), and a component only if all its paths are; nothing else is lost.

Defined results: a text that is null or has no words has the empty set and is linked with
nothing, kept as its own component; a repeated doc_id is one node: its rows' sets all take part
and its rows with words share a component, and each row gives a row; rows with a null doc_id are left
out; an empty table gives no rows; extra columns are ignored.

Where a doc_id stands for several classes, all but one of these go by a 64-bit hash of their digest
instead; nothing else depends on hashes of fewer than 128 bits than what a text's own hash tells apart within a doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memo, sieve, task_memo, written
from .components import components

COORDINATES, MATCHES, BLOCK, WORD_MEMO = 32, 17, 1000, 300_000
SMALL = 6
_WORDS: dict[bytes, int] = {}
_RNG = np.random.default_rng(97)
FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def claim_words() -> None:
    claim_memo("words", _WORDS.clear)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words: A-Z lower-cased, cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_WORDS) > WORD_MEMO:
        _WORDS.clear()
    get, digest = _WORDS.get, xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _WORDS[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted different hashes of the text's shingles; fewer words than `width` are one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(width, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, digest of the set, sig (32-bit minima) of each row."""

    def run(batches):
        claim_words()
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), COORDINATES), np.uint32)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for c in range(COORDINATES):
                    sig[full, c] = np.minimum.reduceat((flat * FACTORS[c] + OFFSETS[c]) >> np.uint64(32), starts)
            flat_sig = pa.array(sig.view(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES), flat_sig)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(digests, pa.binary()), lists], ["doc_id", "th", "n_shingles", "digest", "sig"])

    return _keyed(docs).mapInArrow(task_memo(run), "doc_id long, th long, n_shingles long, digest binary, sig array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _roots(n: int, linked) -> np.ndarray:
    """Least reachable index of each of n items; linked(i) gives the items linked to i, all at once."""
    root = np.arange(n)
    for i in range(n):
        others = np.unique(root[linked(i)])
        others = others[others != root[i]]
        if len(others):
            least = min(int(others[0]), int(root[i]))
            root[np.isin(root, np.append(others, root[i]))] = least
    return root


def _stars(docs: np.ndarray, root: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    order = np.flatnonzero(root != np.arange(len(root)))
    return [(docs[order], docs[root[order]])] if len(order) else []


def signature_links(docs: np.ndarray, sig: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links to local roots among the members of one list that agree in MATCHES coordinates."""
    n, cache = len(docs), {}

    def linked(i):
        block = i // 64
        if block not in cache:
            cache.clear()
            rows, count = sig[block * 64 : block * 64 + 64], 0
            for c in range(COORDINATES):
                count = count + (rows[:, c, None] == sig[None, :, c]).astype(np.uint8)
            cache[block] = count >= MATCHES
        return cache[block][i - block * 64]

    return _stars(docs, _roots(n, linked))


def exact_links(docs: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links to local roots by exact set similarity den * intersection >= num * union."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    rows, keep = np.repeat(np.arange(len(sets)), sizes), shared[column]
    rows, columns, width = rows[keep], place[column[keep]], int(shared.sum())
    starts, cache, n = np.searchsorted(rows, np.arange(len(sets) + 1)), {}, len(sets)

    def linked(i):
        block = i // 256
        if block not in cache:
            cache.clear()
            top = min(n, block * 256 + 256)
            inter = np.zeros((top - block * 256, n), np.float32)
            for lo in range(0, width, 2048):
                own = np.zeros((n, min(2048, width - lo)), np.float32)
                here = (columns >= lo) & (columns < lo + 2048)
                own[rows[here], columns[here] - lo] = 1
                inter += own[block * 256 : top] @ own.T
            inter = inter.astype(np.int64)
            union = sizes[block * 256 : top, None] + sizes[None, :] - inter
            cache[block] = den * inter >= num * union
        return cache[block][i - block * 256]

    del starts, values
    return _stars(docs, _roots(n, linked))


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _grouped(batches):
    """Batches of whole groups: the first column numbers the group and rows come group by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(key != key[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if held and held[-1].column(0)[0].as_py() != int(key[0]):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _list_links(batches):
    for t in _grouped(batches):
        t = t.combine_chunks()
        key, docs = t.column(0).to_numpy(), t.column(1).to_numpy()
        sig = t.column(2).chunk(0).flatten().to_numpy().reshape(len(docs), COORDINATES)
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        size = np.diff(edges)
        small = np.repeat(size <= SMALL, size)
        found = []
        for off in range(1, SMALL):
            at = np.flatnonzero(small[:-off] & (key[:-off] == key[off:])) if len(key) > off else np.zeros(0, np.int64)
            at = at[(sig[at] == sig[at + off]).sum(axis=1) >= MATCHES]
            if len(at):
                found.append((docs[at + off], docs[at]))
        for g in np.flatnonzero(size > SMALL):
            found += signature_links(docs[edges[g] : edges[g + 1]], sig[edges[g] : edges[g + 1]])
        yield _edges(found)


def _cluster_links(width: int, num: int, den: int):
    def run(batches):
        claim_words()
        for t in _grouped(batches):
            key, docs, texts = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2)
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            found = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                sets = [shingle_set(x, width) for x in texts.slice(lo, hi - lo).to_pylist()]
                if hi - lo == 2:
                    inter = len(np.intersect1d(*sets, assume_unique=True))
                    if den * inter >= num * (len(sets[0]) + len(sets[1]) - inter):
                        found.append((docs[lo + 1 : hi], docs[lo : lo + 1]))
                else:
                    found += exact_links(docs[lo:hi], sets, num, den)
            yield _edges(found)

    return run


def _blocked(rows: DataFrame, key: str, size: str, payload: str) -> DataFrame:
    """grp, doc_id, payload: whole groups up to BLOCK members, all pairs of blocks of larger ones."""
    blocks = F.expr(f"cast(ceil({size} / {BLOCK}) as int)")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    paired = rows.withColumn("blocks", blocks).withColumn("own", own)
    one = paired.where("blocks = 1").select(F.xxhash64(key, F.lit(0), F.lit(0)).alias("grp"), "doc_id", payload)
    more = paired.where("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "doc_id", payload)
    return one.unionAll(more).repartition("grp").sortWithinPartitions("grp", "doc_id")


def _links(docs: DataFrame, sigs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """classes (digest, rep, th, node) and the confirmed links (a, b) between their nodes."""
    classes = written(sigs.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("rep")).select("digest", "rep.*"), "classes")
    several = written(classes.groupBy("doc_id").agg(F.min("digest").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), "one"), "several")
    kept = classes.where(~sieve(several, "id")(F.col("doc_id"))).withColumn("node", F.col("doc_id"))
    moved = classes.where(sieve(several, "id")(F.col("doc_id"))).join(several, classes.doc_id == several.id, "left").select(*(classes[c] for c in classes.columns), F.when(F.col("one").isNull() | (classes.digest == F.col("one")), classes.doc_id).otherwise(F.xxhash64(classes.digest)).alias("node"))
    classes = written(kept.unionAll(moved).withColumnRenamed("doc_id", "rep"), "classes")
    reps = sigs.select("digest", "doc_id", "th", "sig").join(classes.withColumnRenamed("th", "rep_th"), "digest").where("doc_id = rep and th = rep_th")
    reps = written(reps.select(F.col("node").alias("doc_id"), "sig").dropDuplicates(["doc_id"]), "representatives")

    posted = reps.select("doc_id", F.posexplode("sig").alias("c", "v")).select("doc_id", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("post"))
    counts = written(posted.groupBy("post").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-posts")
    shared = posted.where(sieve(counts, "post")(F.col("post"))).join(counts.hint("merge"), "post").groupBy("doc_id").agg(F.collect_list(F.struct("n", "post")).alias("posts")).where(F.size("posts") >= MATCHES)
    prefix = shared.select("doc_id", F.explode(F.slice(F.sort_array("posts"), 1, F.size("posts") - (MATCHES - 1))).alias("p")).select("doc_id", "p.post", "p.n")
    prefix = written(prefix, "prefixes")
    members = reps.where(sieve(prefix, "doc_id")(F.col("doc_id")))
    lists = _blocked(prefix.hint("merge").join(members, "doc_id"), "post", "n", "sig")
    clusters = written(components(lists.mapInArrow(_list_links, "a long, b long"), "candidates"), "clusters")

    sized = clusters.join(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component")
    asked = written(classes.where(sieve(clusters, "id")(F.col("node"))).join(sized.hint("merge"), F.col("node") == F.col("id")).select("rep", F.col("th").alias("rep_th"), "node", "component", "n"), "asked")
    keyed = _keyed(docs).where(sieve(asked, "rep")(F.col("doc_id")))
    texts = keyed.join(asked.hint("merge"), (keyed.doc_id == asked.rep) & (keyed.th == asked.rep_th)).select(F.col("node").alias("doc_id"), "component", "n", "text").dropDuplicates(["doc_id"])
    return classes, _blocked(texts, "component", "n", "text").mapInArrow(task_memo(_cluster_links(width, num, den)), "a long, b long")


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with root: a number that the classes of a component share."""
    ids = written(components(links, "links").select(F.col("id").alias("node"), F.col("component").alias("root")), "components")
    return classes.join(ids, "node", "left").select("digest", "rep", "th", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: documents are linked if
    den * |intersection| >= num * |union| of their sets of `width`-word shingles."""
    sigs = written(signatures(docs, width), "signatures")
    classes, links = _links(docs, sigs, width, num, den)
    # the sets of one doc_id are one node
    sets = sigs.where("n_shingles > 0").select("doc_id", "digest")
    repeated = written(sets.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select(F.col("doc_id").alias("id")), "repeated")
    own = sets.where(sieve(repeated, "id")(F.col("doc_id"))).join(repeated, F.col("doc_id") == F.col("id"), "left_semi").join(classes.select("digest", "node"), "digest")
    first = own.groupBy("doc_id").agg(F.min("node").alias("a"))
    links = links.unionAll(own.join(first, "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    labelled = written(_labelled(classes, links), "labelled")
    least = labelled.groupBy("root").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "component")
    member = labelled.join(least, "root", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    found = sigs.select("doc_id", "n_shingles", "digest").join(member, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def unlike_rows(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The doc_id and text hash (id, th) of the row to keep of each component of linked texts, whatever
    ids their rows repeat, and of every row without words; rows with a null doc_id are left out."""
    sigs = written(signatures(docs, width), "signatures")
    labelled = _labelled(*_links(docs, sigs, width, num, den))
    best = labelled.groupBy("root").agg(F.min(F.struct("rep", "th")).alias("best")).select(F.col("best.rep").alias("id"), F.col("best.th").alias("th"))
    return best.unionAll(sigs.where("n_shingles = 0").select("doc_id", "th").distinct())
