import hashlib
import math
import random
import re

from lattica.llm import pii

from .tables import clashing, documents, frame


def plain(text):
    """The base rules by their plain patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        odd, even = [int(x) for x in d[-1::-2]], [int(x) * 2 for x in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(odd) + sum(x - 9 * (x > 9) for x in even)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(4)
    texts = ["a@b@c.de x", "a@b.c@d.e", "@x.y", "a@b..c", "é.a@b.c", "1.2.3.4.5.6.7.8", "001.02.3.256", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (456) 555-2186.", "+12345678", "++1 222 333 44 55+4"]
    texts += ["".join(rng.choice("ab1249.@+- ()é%_") for _ in range(rng.randint(0, 80))) for _ in range(5000)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(40)) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(t)


def test_query_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = ("email", "ip", "card", "phone")
    for r in pii.find_personal_data(docs).collect():
        spans = plain(texts[r.doc_id] or "")
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_disclosing_terms(spark, monkeypatch):
    rng = random.Random(2)
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = []
    for i in range(60):
        noise = " ".join(rng.choice(filler) for _ in range(30))
        if i % 10 == 0:
            rows.append((i, f"{noise} lighthouse keeper me.{1}@x.org {noise}", None, None, None))
        else:
            rows.append((i, noise + (" keeper" if i % 2 else ""), None, None, None))
    df = frame(spark, rows)
    for bits in (pii.TERM_BITS, 5):  # a set that thins, and one that lets all pass
        monkeypatch.setattr(pii, "TERM_BITS", bits)
        got = {r.doc_id: r for r in pii.sanitise(df).collect()}
        assert {r.term for r in pii.disclosures(df).collect()} == {pii.term_key("lighthouse")}
        for i, r in got.items():
            assert ("term" in r.spans) == (i % 10 == 0)
            if i % 10 == 0:
                assert "lighthouse" not in r.clean_text and "@" not in r.clean_text and "keeper" in r.clean_text
            else:
                assert r.clean_text == rows[i][1]


def test_disclosures_against_plain_counts(spark, monkeypatch):
    """PMI and spans from plain counts over all rows; the last row repeats and its copies have no id."""
    rng = random.Random(8)
    pool = [f"{a}{b}" for a in ("al", "be", "ga", "de", "om") for b in ("pha", "ta", "mma", "lta", "ega", "x")]
    rows = []
    for i in range(150):
        text = " ".join(rng.choice(pool[: rng.choice((6, 30))]) for _ in range(rng.randint(5, 60)))
        if i % 3 == 0:
            k = rng.randrange(12)
            text += f" u{k}@x.org Nq{chr(97 + k)} +4930{rng.randrange(3)}123456 " + rng.choice(pool)
        rows.append((i, text, None, None, None))
    rows += [(None, rows[0][1], None, None, None)] * 54
    texts = [r[1] for r in rows]
    docs, has = [], {}
    for t in texts:
        spans = plain(t)
        docs.append({m.group().lower() for m in re.finditer(r"[^\W\d_]+", t) if not any(a < m.end() and m.start() < b for a, _, b in spans)})
    for n, t in enumerate(texts):
        for a, k, b in plain(t):
            has.setdefault((k, t[a:b]), set()).add(n)
    every = [{w.lower() for w in re.findall(r"[^\W\d_]+", t)} for t in texts]
    n, want = len(texts), {}
    for (kind, value), own in has.items():
        for term in {w for i in own for w in docs[i]}:
            both, with_term = sum(term in docs[i] for i in own), sum(term in w for w in every)
            ratio = math.log2(n * both / (len(own) * (with_term + 1))) / math.log2(n / len(own))
            if ratio >= pii.GENERALISE:
                want[pii.entity_key(kind, value), pii.term_key(term)] = ratio
    for most in (pii.MOST_TERMS, 3):
        monkeypatch.setattr(pii, "MOST_TERMS", most)
        got = {(r.entity, r.term): r.ratio for r in pii.disclosures(frame(spark, rows)).collect()}
        assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        for r in pii.find_personal_data(frame(spark, rows)).collect():
            text = next(t for i, t, *_ in rows if i == r.doc_id)
            spans = plain(text)
            keys = {pii.entity_key(k, text[a:b]) for a, k, b in spans}
            terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]+", text) if any((k, pii.term_key(m.group().lower())) in want for k in keys) and not any(a < m.end() and m.start() < b for a, _, b in spans)]
            assert {s for s in r.spans.split(",") if s.startswith("term")} == set(terms)


def test_terms_of_an_entity_of_one_document(spark, monkeypatch):
    """Whatever the distance and the length; words that others use as well stay."""
    rng = random.Random(3)
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, " ".join(rng.choice(filler) for _ in range(120)), None, None, None) for i in range(2000)]
    plain7 = rows[7][1]
    rows[7] = (7, f"Xu Quillfeather {plain7} xu@home.org {plain7} quillfeather", None, None, None)
    for most in (pii.MOST_TERMS, 3):
        monkeypatch.setattr(pii, "MOST_TERMS", most)
        got = {r.doc_id: r for r in pii.sanitise(frame(spark, rows)).collect()}
        assert got[7].clean_text == f"[TERM] [TERM] {plain7} [EMAIL] {plain7} [TERM]"
        assert all(got[i].clean_text == rows[i][1] for i in got if i != 7)


def test_awkward_rows(spark):
    rows = documents()
    got = pii.sanitise(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[85].clean_text is None and by[85].spans == "" and by[85].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(frame(spark, [])).count() == 0
