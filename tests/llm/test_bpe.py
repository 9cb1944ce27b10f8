import hashlib
import random

import pytest
from tokenizers import Tokenizer as Library

from lattica.llm import bpe, token_counts

from .tables import clashing, documents, frame

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def odd_texts():
    rng = random.Random(1)
    yield from ["", "ΣΑΣ ΟΔΟΣ", "İstanbul", "it's we'RE they'll", "<|endoftext|>hi<|startoftext|> a", "日本語 🤖👍🏽", "a" * 5000, "½ ² x²", "ﷺ ŉ ẞ", "é x́ ́"]
    for _ in range(1500):
        yield "".join(rng.choice("abcdeéñßij.,'1Ωжλ́ \n") for _ in range(rng.randrange(60)))
    for _ in range(1500):
        yield "".join(rng.choice("theinrsaot") for _ in range(rng.randrange(5, 60)))


def test_against_the_library(library):
    own = bpe.Tokenizer(PATH)
    for t in odd_texts():
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert own.ids(t) == ids, t
        assert own.digests([t])[0][:3] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t


def test_any_characters_against_the_library(library):
    """Unassigned and new characters, marks of every class, and separators, alone and among letters."""
    own, rng = bpe.Tokenizer(PATH), random.Random(7)
    texts = ["".join(chr(x) for x in range(at, at + 16) if not 0xD800 <= x < 0xE000) for at in range(0, 0x32000, 16)]
    odd = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and bpe.unsettled()[ord(c)]]
    for _ in range(20_000):
        texts.append("".join(rng.choice(odd) if rng.random() < 0.5 else rng.choice("aé 1'\u0301\u1e0aŵΣ\n한각") for _ in range(rng.randint(1, 9))))
        texts.append("".join(chr(rng.choice((rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x1FBFF)))) for _ in range(rng.randint(1, 6))))
    for t, got, want in zip(texts, own.all_ids(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got == want.ids, ascii(t)


def test_forgetting_changes_nothing(library, monkeypatch):
    for name, value in (("PAIR_BITS", 4), ("LONGEST", 6), ("GROUP", 40)):
        monkeypatch.setattr(bpe, name, value)
    own, texts = bpe.Tokenizer(PATH, 5), list(odd_texts())[:400]
    for t in texts:
        assert own.ids(t) == library.encode(t, add_special_tokens=False).ids, t
    assert own.all_ids(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.digests(texts) == [bpe.Tokenizer(PATH).digests([t])[0] for t in texts[:1]] + own.digests(texts[1:])


def test_pairs_stay_apart_as_by_the_definition():
    merges, rng = bpe.Tokenizer(PATH).merges, random.Random(5)
    inner = [t for t, s in merges.spelled.items() if s[-1] < 256]
    pairs = [(rng.choice(inner), rng.choice(list(merges.spelled))) for _ in range(1500)]
    pairs += [(a, a) for a in inner[::40]]
    want = [merges.plain(merges.spelled[a] + merges.spelled[b]) == [a, b] for a, b in pairs]
    assert merges.apart(*(bpe.np.array(x) for x in zip(*pairs))).tolist() == want


def test_lookahead_bounds_open_ends():
    own = bpe.Tokenizer(PATH)
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("theinrsaoct") for _ in range(80)).encode()
        ends = [(0, (-1,))]
        for x in word[:-1]:
            ends, _ = own.encoder.step(ends, x)
            assert len(ends) <= own.merges.lookahead + 1
            assert max(len(c) for _, c in ends) <= own.merges.lookahead + 2
        assert own.encoder.word(word) == own.merges.lockstep([word])[0]


def test_byte_state_machine_gives_the_text_back():
    own = bpe.Tokenizer(PATH)
    for t in ("hello wörld", "日本 語 🤖", "naïve café"):
        for some in (1, 2, 100):
            decoder, ids = own.decoder(), own.ids(t)
            assert ("".join(decoder.feed(ids[i : i + some]) for i in range(0, len(ids), some)) + decoder.finish()).strip() == own.normal(t)
    broken, cut = own.ids("\U00010348")[:1], own.decoder()
    assert cut.feed(broken) + cut.finish() == "\ufffd"


def test_rows_and_histogram(spark, library):
    rows = documents()
    want = {(r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows}
    assert {(r.doc_id, r.n_tokens) for r in bpe.round_trip(clashing(spark, rows)).collect()} == want
    lengths = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    hist = token_counts.token_histogram(clashing(spark, rows))
    got = {r.n_tokens: r for r in hist.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert (r.docs, r.tokens) == (lengths.count(limit), limit * lengths.count(limit))
        assert (r.docs_ge, r.tokens_ge) == (sum(x >= limit for x in lengths), sum(x for x in lengths if x >= limit))
        assert (r.docs_le, r.tokens_le) == (sum(x <= limit for x in lengths), sum(x for x in lengths if x <= limit))
        assert r.tokens_truncated == sum(min(x, limit) for x in lengths)
        assert r.quantile == pytest.approx(sum(x <= limit for x in lengths) / len(lengths))
    one = token_counts.at_limit(hist, 50).head()
    assert tuple(one) == (sum(x > 50 for x in lengths), sum(x for x in lengths if x > 50), sum(min(x, 50) for x in lengths))
    assert bpe.round_trip(frame(spark, [])).count() == 0
    assert token_counts.token_histogram(frame(spark, [])).count() == 0
    full = bpe.encode_column(frame(spark, rows[:5])).collect()
    assert [list(r.ids) for r in full] == [library.encode(r[1], add_special_tokens=False).ids for r in rows[:5]]
