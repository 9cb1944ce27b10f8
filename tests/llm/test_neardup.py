import random
import re
from itertools import combinations

import pytest

from lattica.llm import common, neardup

from .tables import clashing, documents, frame, words


def brute(rows, width, num, den):
    def shingles(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))

    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        inter = len(x & y)
        if a != b and inter and den * inter >= num * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {(d, len(s), find(d) if s else d, find(d) == d or not s) for d, s in sets}


def answer(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, width, num):
    rows = documents()
    got = answer(neardup.near_duplicates(clashing(spark, rows), width, num, 100))
    assert got == brute(rows, width, num, 100)
    assert len({c for _, _, c, _ in got}) < len(got)


def test_blocks_of_large_lists_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(common, "HOT_ROWS", 4)  # hubs by broadcast
    monkeypatch.setattr(common, "HOT_KEYS", 500)
    rows = documents(seed=3)
    assert answer(neardup.near_duplicates(frame(spark, rows), 3, 85, 100)) == brute(rows, 3, 85, 100)


def test_empty_table_and_repeated_rows(spark):
    assert answer(neardup.near_duplicates(frame(spark, []), 3, 85, 100)) == set()
    rows = [(1, "a b c d", None, None, None)] * 2 + [(2, "a b c d", None, None, None), (None, "a b c d", None, None, None)]
    got = neardup.near_duplicates(frame(spark, rows), 3, 85, 100).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(2)
    a, b, c = (words(rng, 120) for _ in range(3))
    near = lambda w: " ".join([*w[:60], "other", *w[61:]])
    a_, b_, c_ = (" ".join(w) for w in (a, b, c))
    for texts in ([(1, a_), (1, b_), (2, near(a)), (3, near(b))], [(7, a_), (7, b_), (3, b_)], [(7, a_), (7, b_), (7, ""), (8, near(b)), (9, c_), (9, near(c)), (9, None), (5, c_), (6, near(a))]):
        rows = [(d, t, None, None, None) for d, t in texts]
        assert answer(neardup.near_duplicates(frame(spark, rows), 3, 85, 100)) == brute(rows, 3, 85, 100)
    rows = [(d, t, None, None, None) for d, t in [(7, a_), (7, a_), (7, b_), (7, near(b)), (8, near(a)), (9, c_), (9, "")]]
    keep = neardup.unlike_rows(frame(spark, rows), 5, 80, 100).collect()
    hashes = {r.h: r.text for r in frame(spark, rows).selectExpr("text", "xxhash64(text) as h").collect()}
    got = sorted((r.id, hashes[r.th]) for r in keep)
    assert [d for d, _ in got] == [7, 7, 9, 9] and (7, a_) in got and sum(t in (b_, near(b)) for _, t in got) == 1


def test_driver_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    assert answer(neardup.near_duplicates(docs, 3, 85, 100)) == brute(rows, 3, 85, 100)
