import random

import numpy as np

from lattica.llm import decontamination as dc

from .tables import clashing, documents, frame, words


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j], row[j + 1])
            last = keep
    return row[-1]


def slow_run(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(len(b) + 1) if a[i : i + k] == b[j : j + k] and i + k <= len(a) and j + k <= len(b)), default=0)


def test_word_comparisons():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randint(0, 12))], [rng.randrange(5) for _ in range(rng.randint(0, 9))]
        assert dc.lcs_length(a, b) == slow_lcs(a, b)
        assert dc.longest_run(a, b) == slow_run(a, b)


def planted(rng):
    common = words(rng, 40, "aeio")
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(16, 50)))) for i in range(20)]
    rows, truth = [], set()
    for d in range(150):
        w = text(rng.randint(60, 400))
        if d % 5 == 0:
            i = rng.randrange(20)
            own = items[i][1].split()
            if d % 10 == 0:  # a paraphrase: a fifth of the words changed
                own = [words(rng, 1, "xyz")[0] if rng.random() < 0.2 else x for x in own]
            at = rng.randrange(len(w))
            w[at:at] = own
            truth.add((d, i))
        rows.append((d, " ".join(w), None, None, None))
    return items, rows, truth


def test_planted_items_and_paraphrases(spark):
    items, rows, truth = planted(random.Random(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(frame(spark, rows), bench).collect()}
    assert {d for d, _ in got} <= {d for d, _ in truth}
    assert len(got & truth) >= 0.95 * len(truth)
    exact = {t for t in truth if t[0] % 10}
    assert exact <= got


def test_paraphrased_rare_words_and_stretches_of_long_items(spark):
    """The rarest third of the words replaced (LCS about 0.67), and 13 words of an item of 60."""
    rng = random.Random(8)
    common = words(rng, 40, "aeio")
    fill = lambda n: [rng.choice(common) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(n)]
    items = [(i, " ".join(rng.sample(common, 20) + words(rng, 10))) for i in range(5)] + [(i, " ".join(fill(60))) for i in range(5, 10)]
    rows, truth = [], set()
    for d in range(40):
        w, i = fill(200), d % 10
        own = items[i][1].split()
        if d < 20:
            w[70:70] = own[:20] + words(rng, 10, "xyz") if i < 5 else own[30:43]
            truth.add((d, i))
        rows.append((d, " ".join(w), None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(frame(spark, rows), bench).collect()} == truth


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items, rows, truth = planted(random.Random(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "ITEMS", 7)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(frame(spark, rows), bench).collect()}
    assert {t for t in truth if t[0] % 10} <= got


def test_basis_is_that_of_the_full_decomposition(spark):
    items, rows, _ = planted(random.Random(5))
    it = dc.Items(items)
    it.weigh(np.ones(len(it.vocab)), 10)
    basis = dc._fit_basis(spark.createDataFrame([], "doc_id long, ids binary"), it, 0)
    a = np.zeros((len(items), it.width))
    for n, w in enumerate(it.words):
        x, v = it.row(np.array(w))
        a[n, x] = v
    exact = np.linalg.svd(a)[2][:20]
    assert np.allclose(np.linalg.norm(exact @ basis, axis=1), 1, atol=1e-3)
    it.use_basis(basis)
    for n, w in enumerate(it.words):  # a verbatim item has cosine 1, and no passage more
        assert abs(it.cosine(np.array(w), n) - 1) < 1e-5
        assert all(-1 <= it.cosine(np.array(w), m) <= 1 for m in range(len(items)))


def test_counts_and_basis_by_partitions(spark):
    items, rows, _ = planted(random.Random(6))
    it = dc.Items(items)
    numbered = dc._numbered(frame(spark, rows).select("doc_id", "text").repartition(3), it)
    df = dc._document_counts(numbered, it)
    texts = [set(dc.words_of(r[1])) for r in rows]
    assert {w: df[n] for w, n in it.vocab.items()} == {w: sum(w in t for t in texts) for w in it.vocab}
    it.weigh(df, len(rows))
    basis = dc._fit_basis(numbered, it, len(rows))
    assert basis.shape == (len(it.vocab), min(dc.RANK, len(it.vocab))) and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)


def test_basis_is_fitted_on_every_passage(spark, monkeypatch):
    """Against the full decomposition of all passages of long texts, in which every fourth passage has other words
    than the rest."""
    monkeypatch.setattr(dc, "RANK", 8)
    monkeypatch.setattr(dc, "OVERSAMPLE", 60)
    monkeypatch.setattr(dc, "GROUP", 1024)  # texts of several blocks
    rng = random.Random(16)
    vocab = words(rng, 160)
    topics = [vocab[i : i + 10] for i in range(0, 160, 10)]
    items = [(i, " ".join(rng.sample(t, 10))) for i, t in enumerate(topics)]
    passage = lambda t: [rng.choice(t) if rng.random() < 0.8 else "unknown" for _ in range(dc.PASSAGE)]
    texts = [[x for p in range(rng.randint(120, 140)) for x in passage(topics[rng.randrange(8) + 8 * (p % 4 > 0)])] for _ in range(20)]
    rows = [(d, " ".join(w[: len(w) - d]), None, None, None) for d, w in enumerate(texts)]
    it = dc.Items(items)
    numbered = dc._numbered(frame(spark, rows).select("doc_id", "text").repartition(3), it)
    it.weigh(dc._document_counts(numbered, it), len(rows))
    basis = dc._fit_basis(numbered, it, len(rows)).astype(np.float64)
    passages = [it.numbers(r[1])[i : i + dc.PASSAGE] for r in rows for i in range(0, len(r[1].split()), dc.PASSAGE)]
    known = [p[p < len(it.vocab)] for p in passages if (p < len(it.vocab)).any()]
    scale = (len(known) / len(items)) ** 0.5
    gram = np.zeros((it.width, it.width))
    for p, s in [(p, 1.0) for p in known] + [(np.array(w), scale) for w in it.words]:
        x, c = np.unique(p, return_counts=True)
        v = c * it.idf[x].astype(np.float64)
        v *= s / np.linalg.norm(v)
        gram[np.ix_(x, x)] += np.outer(v, v)
    best = np.linalg.eigvalsh(gram)[-dc.RANK :].sum()
    assert np.trace(basis.T @ gram @ basis) >= 0.999 * best


def test_supported_passages_are_those_with_enough_words():
    """Of items of up to 64 different words exactly those, of longer ones none of them is lost."""
    rng = random.Random(21)
    vocab = words(rng, 200)
    it = dc.Items([(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([1, 5, 20, 30, 40, 100, 180])])
    for n in (1, 7, 60, 900):
        ids = it.numbers(" ".join(rng.choices([*vocab[:60], "other"], k=n)))
        found = [(i, lo, min(lo + 24, n)) for i in range(len(it.ids)) for lo in range(0, n, dc.STEP)]
        around = lambda i, lo, hi: set(ids[max(0, lo - int(it.sizes[i])) : hi + int(it.sizes[i])].tolist())
        want = [x for x in found if sum(it.counts[x[0]][w] for w in around(*x)) >= it.needed[x[0]]]
        got = list(it.supported(ids, found))
        assert set(want) <= set(got) and [x for x in got if len(it.counts[x[0]]) <= 64] == [x for x in want if len(it.counts[x[0]]) <= 64]


def test_scattered_words_are_no_candidates(monkeypatch):
    """All words of an item in a long text, four of them at a place: no passage needs a look. Where another item stands
    in the same text, at segments' borders too, it is found."""
    rng = random.Random(22)
    it = dc.Items([(1, " ".join(words(rng, 30))), (2, " ".join(words(rng, 40)))])
    it.weigh(np.ones(len(it.vocab)), 10)
    it.use_basis(np.eye(it.width, dtype=np.float32))
    looked, supported = [], dc.Items.supported
    monkeypatch.setattr(dc.Items, "supported", lambda self, ids, found: supported(self, ids, looked.extend(found) or found))
    scattered = np.concatenate([[*it.words[0][n : n + 4] * 10, *[len(it.vocab)] * 300] for n in range(0, 30, 4)])
    assert it.matches([scattered]) == [{}] and not looked
    for at in [0, 1, 60, 100, 120, 127, 128, 250, 1000, 2600, len(scattered)]:
        text = np.insert(scattered, at, it.words[1])
        found = it.matches([scattered[:50], text])
        assert found[0] == {} and list(found[1]) == [1] and found[1][1][1:] == (1.0, True, 40)


def test_possible_segments_hold_every_passage_with_enough_words():
    rng = random.Random(23)
    vocab = words(rng, 150)
    it = dc.Items([(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([1, 5, 20, 30, 40, 59])])
    texts = [it.numbers(" ".join(rng.choices([*vocab, *["other"] * 300], k=n))) for n in (0, 1, 7, 128, 129, 900, 12_000)]
    length, possible = it.possible(texts)
    assert [len(p) for p in possible] == [-(-len(t) // length) for t in texts] and not possible[-1].all()
    for t, p in zip(texts, possible):
        for i, (size, width) in enumerate((int(s), w) for s in it.sizes for w in dc.WIDTHS[-1:]):
            for lo in range(0, len(t), dc.STEP):
                around = set(t[max(0, lo - size) : lo + width + size].tolist())
                if sum(it.counts[i][x] for x in around) >= it.needed[i]:
                    assert p[lo // length, i]


def test_numbers_are_those_of_the_words():
    every = "".join(map(chr, range(256)))
    texts = [None, "", " ", every, *(f"a{c}B" for c in every), "ÀÉ Straße µm ½ ª_x 3²", "İstanbul ΣΑΣ œuvre naïve", "漢字 a b", "a\u2019b C", "x\ud800y"]
    it = dc.Items([(n, t) for n, t in enumerate(texts) if t and dc.words_of(t)][::2])
    for t in texts:
        assert it.numbers(t).tolist() == [it.vocab.get(w, len(it.vocab)) for w in dc.words_of(t)]


def test_search_against_all_passages_and_items(spark):
    """Every item against the surroundings of every window: what the rules confirm is found, at least 0.95 of it,
    of paraphrases of every degree; nothing else is reported."""
    rng = random.Random(12)
    common = words(rng, 60, "aeio")
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else words(rng, 1)[0] for _ in range(n)]
    items = [(i, " ".join(text(rng.randint(15, 60)))) for i in range(40)]
    rows = []
    for d in range(160):
        w, own = text(rng.randint(100, 300)), items[d % 40][1].split()
        lost = rng.random() * 0.55
        own = [words(rng, 1, "xyz")[0] if rng.random() < lost else x for x in own]
        at = rng.randrange(len(w))
        rows.append((d, " ".join(w[:at] + own + w[at:]), None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(frame(spark, rows), bench).collect()}
    it, want = dc.Items(items), set()
    for d, t, *_ in rows:
        ids = it.numbers(t)
        for i, size in enumerate(it.sizes):
            for lo in range(0, len(ids), dc.STEP):
                if it.confirmed(ids.tolist(), i, lo, lo + int(size), False) or any(x[0] == i for x in it.stretches(ids)):
                    want.add((d, i))
                    break
    assert 90 < len(want) < 160 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(want)


def test_awkward_rows(spark):
    rows = documents()
    bench = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b", 1), (3, rows[60][1], 1), (4, "...", 1)], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(clashing(spark, rows), bench).collect()}
    assert (60, 3) in got and {i for _, i in got} == {3}
    assert dc.leaks(frame(spark, []), bench).count() == 0
    assert dc.leaks(frame(spark, rows), bench.limit(0)).count() == 0
