import hashlib
import zlib

import pytest

from lattica.llm import sharding

from .tables import clashing, documents, frame


def brute(rows, shards=16):
    keys = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), -(1 << 63) if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), i) for i, t, *_ in rows)
    units = {}
    for k, d, size, *_ in keys:
        units[k, d] = units.get((k, d), 0) + size
    total, before, shard, out, at = sum(units.values()), 0, {}, [], {}
    for key, size in sorted(units.items()):
        shard[key] = (2 * before + size) * shards // (2 * total)
        before += size
    for k, d, size, crc, i in keys:
        s = shard[k, d]
        out.append((i, size, crc, "bytes", s, at.get(s, 0), None))
        at[s] = at.get(s, 0) + 1
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("finish,probes", [(20_000, 256), (3, 2)])
def test_exact_splitters(spark, monkeypatch, finish, probes):
    monkeypatch.setattr(sharding, "FINISH_ROWS", finish)
    monkeypatch.setattr(sharding, "FIRST_PROBES", probes)
    monkeypatch.setattr(sharding, "PROBES", probes)
    rows = documents(n=40) + [(1000 + i, "a text that many share", "en", "s", 1) for i in range(60)]
    assert got(sharding.shard_documents(clashing(spark, rows), fine=2)) == brute(rows)


def test_probing_with_the_production_parameters(spark):
    """More rows than are fetched to finish: the splitters come from probes."""
    rows = [(i, f"{i % 9000} " * (1 + i % 13), None, None, None) for i in range(30_000)]
    assert len(rows) > sharding.FINISH_ROWS
    assert got(sharding.shard_documents(frame(spark, rows))) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "same", None, None, None)] * 40 + [(6, "other", None, None, None), (None, None, None, None, None)]
    assert got(sharding.shard_documents(frame(spark, rows), fine=2)) == brute(rows)
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_slots_are_gapless_and_sizes_near_equal(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
