"""Histogram sort: exact equal-byte shards of a totally ordered table, with one exchange.

Keys are ordered by (60-bit prefix of the text's MD5, doc_id), so equal texts stand side by
side and stay in one shard unless a boundary must cut through them for balance. A small
written table of keys and sizes is probed in rounds: each round counts exact bytes and rows
between candidate boundaries inside the cells that still hold a splitter, on all partitions,
and only these counts (at most ``cells * PROBES`` rows) reach the driver. When the cells
together hold at most ``FINISH_ROWS`` rows, their keys are fetched and the splitters are
exact to the row. Then rows are dealt once.

Defined results: a null text has size 1 and CRC 0 and sorts as the empty text; a null doc_id
sorts first; rows that agree in (text hash, doc_id) are one key and never parted; an empty
table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FINISH_ROWS = 20_000
INTERVAL_ROWS, MOST_INTERVALS = 1_000_000, 4096
FIRST_PROBES = 4096
PROBES = 256
LEAST_LONG = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (k, d)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("k"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_LONG)).alias("d"),
    )


def _tree(lo: int, hi: int, test, leaf) -> Column:
    """Balanced nested CASE over lo..hi: test(m) says that the row lies at m or above."""
    if lo == hi:
        return leaf(lo)
    mid = (lo + hi + 1) // 2
    return F.when(test(mid), _tree(mid, hi, test, leaf)).otherwise(_tree(lo, mid - 1, test, leaf))


def _at_least(key: tuple[int, int]) -> Column:
    k, d = F.lit(key[0]), F.lit(key[1])
    return (F.col("k") > k) | ((F.col("k") == k) & (F.col("d") >= d))


class _Cell:
    """A key interval with the exact bytes and rows before it and inside it."""

    def __init__(self, bytes_before, rows_before, size, rows, k, d):
        self.bytes_before, self.rows_before, self.size, self.rows, self.k, self.d = bytes_before, rows_before, size, rows, k, d

    @property
    def single(self) -> bool:
        return self.k[0] == self.k[1] and self.d[0] == self.d[1]


def _inside(cells: list[_Cell]) -> Column:
    """True for the rows of these cells."""
    out = F.lit(False)
    for c in cells:
        here = F.col("k").between(*c.k)
        out |= here & F.col("d").between(*c.d) if c.k[0] == c.k[1] else here
    return out


def _after(k: int, d: int) -> tuple[int, int]:
    return (k, d + 1) if d < (1 << 63) - 1 else (k + 1, LEAST_LONG)


def _probe(keys: DataFrame, cells: list[_Cell], probes: int) -> list[_Cell]:
    """Split each cell into up to `probes` intervals and count exactly what each holds."""
    parts = []
    for cell in cells:
        dim = "k" if cell.k[0] < cell.k[1] else "d"
        lo, hi = cell.k if dim == "k" else cell.d
        parts.append((dim, lo, (hi - lo) // probes + 1))
    starts = [(c.k[0], c.d[0] if c.k[0] == c.k[1] else LEAST_LONG) for c in cells]
    step = lambda i: F.floor((F.col(parts[i][0]) - F.lit(parts[i][1])) / F.lit(parts[i][2])) if parts[i][2] > (1 << 52) else F.expr(f"({parts[i][0]} - ({parts[i][1]}L)) div {parts[i][2]}L")
    cell_id = _tree(0, len(cells) - 1, lambda m: _at_least(starts[m]), lambda i: F.lit(i))
    sub_id = _tree(0, len(cells) - 1, lambda m: _at_least(starts[m]), step)
    counted = (
        keys.where(_inside(cells))
        .groupBy(cell_id.alias("c"), sub_id.cast("long").alias("s"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
        .collect()
    )
    out: list[_Cell] = []
    at = {i: (c.bytes_before, c.rows_before) for i, c in enumerate(cells)}
    for r in sorted(counted, key=lambda r: (r.c, r.s)):
        b, n = at[r.c]
        out.append(_Cell(b, n, r["size"], r.n, (r.k0, r.k1), (r.d0, r.d1)))
        at[r.c] = (b + r["size"], n + r.n)
    return out


def splitters(keys: DataFrame, parts: int) -> list[tuple[tuple[int, int], int]]:
    """For i = 1..parts-1: the first key whose middle byte lies at or past i / parts of all
    bytes, and the rows before it. So a boundary is off by half a key's bytes at most."""
    whole = keys.agg(F.sum("size"), F.count(F.lit(1)), F.min("k"), F.max("k"), F.min("d"), F.max("d")).head()
    if not whole[1]:
        return []
    total, n = whole[0], whole[1]
    targets = list(range(1, parts))
    cells = [_Cell(0, 0, total, n, (whole[2], whole[3]), (whole[4], whole[5]))]
    found: dict[int, tuple[tuple[int, int], int]] = {}
    probes = FIRST_PROBES
    while True:
        # a target's splitter is the first key at or beyond its byte position
        need: dict[int, list[int]] = {}
        for i in targets:
            if i in found:
                continue
            for j, c in enumerate(cells):
                if parts * c.bytes_before >= i * total:
                    found[i] = ((c.k[0], c.d[0] if c.k[0] == c.k[1] else LEAST_LONG), c.rows_before)
                    break
                if parts * (c.bytes_before + c.size) > i * total:
                    if c.single:
                        below = parts * (2 * c.bytes_before + c.size) < 2 * i * total
                        found[i] = (_after(c.k[1], c.d[1]), c.rows_before + c.rows) if below else ((c.k[0], c.d[0]), c.rows_before)
                    else:
                        need.setdefault(j, []).append(i)
                    break
            else:
                found[i] = ((1 << 62, LEAST_LONG), n)
        if not need:
            break
        open_cells = [cells[j] for j in sorted(need)]
        if sum(c.rows for c in open_cells) <= FINISH_ROWS:
            by_key: dict[tuple[int, int], list[int]] = {}
            for r in keys.where(_inside(open_cells)).select("k", "d", "size").collect():
                unit = by_key.setdefault((r.k, r.d), [0, 0])
                unit[0] += r["size"]
                unit[1] += 1
            order, at = sorted(by_key), 0
            for j in sorted(need):
                c, pending = cells[j], sorted(need[j])
                bytes_before, rows_before, end = c.bytes_before, c.rows_before, c.rows_before + c.rows
                while rows_before < end:
                    size, rows = by_key[order[at]]
                    while pending and parts * (2 * bytes_before + size) >= 2 * pending[0] * total:
                        found[pending.pop(0)] = (order[at], rows_before)
                    bytes_before, rows_before, at = bytes_before + size, rows_before + rows, at + 1
                for i in pending:
                    found[i] = (_after(*order[at - 1]), rows_before)
            break
        cells = _probe(keys, open_cells, probes)
        probes = PROBES
    return [found[i] for i in targets]


def histogram_shards(keys: DataFrame, shards: int = 16, fine: int | None = None) -> DataFrame:
    """keys (from keyed()) with shard and slot: row counts from 0 without gaps in each shard.

    The key space is cut into shards * fine intervals of near equal bytes, so that numbering
    the slots takes many small sorts, not one for each shard: of INTERVAL_ROWS rows on average, in at most
    MOST_INTERVALS.
    """
    if fine is None:
        fine = max(8, min(MOST_INTERVALS // shards, keys.count() // (shards * INTERVAL_ROWS)))
    cuts = splitters(keys, shards * fine)
    starts = [0] + [rows for _, rows in cuts]
    if not cuts:
        return keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    offset = [starts[i] - starts[i - i % fine] for i in range(len(starts))]
    part = _tree(0, len(cuts), lambda m: _at_least(cuts[m - 1][0]), lambda i: F.lit(i))
    numbered = keys.withColumn("part", part).withColumn(
        "slot",
        F.row_number().over(Window.partitionBy("part").orderBy("k", "d", "size", "text_crc32")) - 1
        + F.element_at(F.lit(offset).cast("array<bigint>"), F.col("part") + 1),
    )
    return numbered.select("doc_id", "size", "text_crc32", F.floor(F.col("part") / fine).cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, fine: int | None = None) -> DataFrame:
    """All documents in `shards` shards of near equal bytes (law `bytes`)."""
    keys = written(keyed(docs), "shard-keys")
    out = histogram_shards(keys, shards, fine)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
