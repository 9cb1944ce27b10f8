import numpy as np
import pytest

from lattica.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    sound = {}
    for i, v, _ in rows:
        if i is not None and v and len(v) == len(rows[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = np.asarray(v, np.float32).astype(np.float64)
    ids = np.array(sorted(sound))
    x = np.stack([sound[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[n]
            order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == set(want)
    hit = total = 0
    for q, near in want.items():
        assert len(got[q]) == len(near)
        for i, s in got[q]:
            total += 1
            hit += s >= near[-1][1] - 1e-9
    return hit / total


def test_recall_on_the_driver_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding), 0) for r in df.collect()])
    assert recall(answers(ann.nearest_neighbours(df)), want) >= 0.9


def test_copies_ties_and_unsound_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(200)]
    rows += [(i, rows[3][1], 0) for i in range(200, 320)]
    rows += [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0] * 7 + [None], 0), (403, [1.0] * 7 + [float("nan")], 0), (404, [1.0] * 3, 0), (450, [float("inf")] * 8, 0), (None, rows[0][1], 0), (7, rows[7][1], 0)]
    got = answers(ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)))
    want = brute(rows)
    assert set(got) == set(want)
    assert [i for i, _ in got[200]] == [i for i, _ in want[200]] == [3, 201, 202, 203, 204]
    assert [i for i, _ in got[250]] == [3, 200, 201, 202, 203]
    assert recall(got, want) >= 0.9


@pytest.mark.parametrize("shape", ["gaussian", "clusters"])
def test_recall_at_twenty_thousand_vectors(spark, shape, monkeypatch):
    """Shapeless vectors, and ones in tight clusters, for which few lists are probed; the queries come in several parts."""
    monkeypatch.setattr(ann, "QUERY_BLOCK", 70)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 64))
    if shape == "clusters":
        x = rng.normal(size=(200, 64))[rng.integers(0, 200, 20_000)] + 0.2 * x
    x, seen, needed = x.astype(np.float32), [], ann.needed_probes
    monkeypatch.setattr(ann, "needed_probes", lambda *a: seen.append(needed(*a)) or seen[-1])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    want = brute([(i, v.tolist(), 0) for i, v in enumerate(x)], every=100)
    assert recall(answers(ann.nearest_neighbours(df, every=100)), want) >= 0.9
    assert seen[0] < 30 if shape == "clusters" else seen[0] > 30


def test_few_and_no_rows(spark):
    got = answers(ann.nearest_neighbours(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [-1.0, 0.0], 0)], SCHEMA)))
    assert got == {0: [(1, pytest.approx(0.5**0.5)), (2, pytest.approx(-1.0))]}
    assert ann.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
