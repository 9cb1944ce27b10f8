import random

from lattica.llm import common, substrings

from .tables import clashing, documents, frame, words


def slow_gear(data):
    h, out, gear = 0, [], substrings.GEAR.tolist()
    for b in data:
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        out.append(h)
    return out


def test_rolling_hash_and_chunks():
    data = random.Random(5).randbytes(5000)
    h = slow_gear(data)
    assert substrings.gear_hashes(data).tolist() == h
    ends, r = substrings.chunk_ends(data).tolist(), substrings.RADIUS
    least = [i + 1 for i in range(31, 5000) if all(h[i] < x for x in h[max(0, i - r) : i]) and all(h[i] <= x for x in h[i + 1 : i + 1 + r])]
    assert [e for e in ends if e in set(least)] == least
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= substrings.MOST and min(sizes) > 0
    moved = substrings.chunk_ends(b"inserted" + data).tolist()
    assert {e for e in ends if e > 60} <= {e - 8 for e in moved}
    assert substrings.chunk_ends(b"").tolist() == []
    assert substrings.chunk_ends(b"a" * 1000).tolist()[-1] == 1000


def brute(rows, width):
    """doc_id -> words that stand in a sequence of `width` words which another document has too."""
    seen = {}
    for i, row in enumerate(rows):
        w = (row[1] or "").split()
        for at in range(len(w) - width + 1):
            seen.setdefault(tuple(w[at : at + width]), set()).add(row[0])
    out = {}
    for row in rows:
        w = (row[1] or "").split()
        for at in range(len(w) - width + 1):
            if len(seen[tuple(w[at : at + width])]) > 1:
                out.setdefault(row[0], set()).update(range(at, at + width))
    return out


def covered(text, passages):
    """Numbers of the words that lie in the spans."""
    data, out, at = text.encode(), set(), 0
    spans = [tuple(map(int, s.split(":"))) for s in passages.split(",") if s]
    for n, w in enumerate(data.split()):
        at = data.index(w, at)
        if any(a <= at and at + len(w) <= b for a, b in spans):
            out.add(n)
        at += len(w)
    return out


def test_against_all_repeated_sequences(spark):
    """Planted repeats of 30 to 80 words among words of three languages' lengths: nothing of at least MIN_WORDS
    words is missed, and nothing is reported that is not in a repeated sequence of WINDOW_WORDS words."""
    rng = random.Random(9)
    passages = [" ".join(words(rng, n)) for n in range(30, 80)]
    rows, n_long = [], 0
    for i in range(400):
        own = words(rng, rng.randint(60, 300))
        if i % 2 == 0:
            p = rng.randrange(len(passages))
            at = rng.randrange(len(own))
            own[at:at] = [passages[p]]
        rows.append((i, rng.choice((" ", "\t", " ", "\n")).join(own), None, None, None))
    got = {r.doc_id: r for r in substrings.repeated_passages(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    must, may = brute(rows, substrings.MIN_WORDS), brute(rows, substrings.WINDOW_WORDS)
    n_long = len(must)
    assert n_long > 60 and {d for d, r in got.items() if r.n_passages} >= set(must)
    for d, r in got.items():
        found = covered(rows[d][1], r.passages)
        assert found <= may.get(d, set())
        if d in must:  # all but what a pick leaves at either end
            assert len(must[d] - found) <= 2 * (substrings.PICK - 1)
            assert bool(r.removed) == any(f < d for f in r.first_docs) and (r.removed_bytes > 0) == bool(r.removed)


def test_frequent_chunks_by_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    passage = " ".join(words(rng, 70))
    rows = [(i, " ".join(words(rng, 40)) + (" " + passage if i % 3 == 0 else "") + " " + " ".join(words(rng, 30)), None, None, None) for i in range(90)]
    want = sorted(substrings.repeated_passages(frame(spark, rows)).collect())
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 500)
    assert sorted(substrings.repeated_passages(frame(spark, rows)).collect()) == want
    assert sum(r.n_passages for r in want) == 30


def test_white_space_is_no_word(spark):
    rng = random.Random(4)
    blank, shared = " " * 600, "\t".join(words(rng, 80))
    rows = [(1, " ".join(words(rng, 20)) + blank + " ".join(words(rng, 20)), None, None, None), (2, " ".join(words(rng, 20)) + blank + " ".join(words(rng, 20)), None, None, None),
            (3, "a b " + shared, None, None, None), (4, shared + "\nend of it", None, None, None), (5, "once " * 300, None, None, None),
            (6, " ".join(words(rng, 60)), None, None, None), (7, None, None, None, None)]
    rows += [(8, rows[5][1], None, None, None), (9, rows[5][1], None, None, None), (9, rows[5][1], None, None, None)]
    got = {r.doc_id: r for r in substrings.repeated_passages(frame(spark, rows)).collect()}
    assert {d for d, r in got.items() if r.n_passages} == {3, 4, 6, 8, 9}
    size = len(rows[5][1])
    assert [(got[d].passages, got[d].removed_bytes, got[d].first_docs) for d in (6, 8, 9)] == [(f"0:{size}", 0, []), (f"0:{size}", size, [6]), (f"0:{size}", size, [6])]


def test_awkward_rows(spark):
    rows = documents()
    got = substrings.repeated_passages(clashing(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted({r[0] for r in rows})
    by = {r.doc_id: r for r in got}
    assert by[85].n_passages == 0 and by[90].removed_bytes >= 0
    assert substrings.repeated_passages(frame(spark, [])).count() == 0
