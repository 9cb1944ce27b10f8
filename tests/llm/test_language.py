import zlib

import numpy as np

from lattica.llm import language

from .tables import clashing, documents, frame


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = language.ByteNet(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data = np.frombuffer(b"abc\0\0zy x\0hello", np.uint8).reshape(3, 5).T.copy()
    target = np.array([[0, 1, 2]] * 3 + [[1, 1, 0]] * 2)
    _, grads = net.gradients(data, target)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name[0] == "x":
                at = (int(data[rng.integers(0, 2), rng.integers(0, 3)]), at[1])
            keep, h = w[at], 1e-3
            w[at] = keep + h
            up, _ = net.gradients(data, target)
            w[at] = keep - h
            down, _ = net.gradients(data, target)
            w[at] = keep
            assert abs((up - down) / (2 * h) - grads[name][at]) < 2e-4, name


def test_segments_cover_every_byte_once_and_cut_no_character():
    for text in ("", "a", "é" * 2000, "日本語" * 999, "x" * 5000, "ab\0c"):
        data = language.bytes_of(text)
        spans = language.segments(data)
        assert [a for _, a, _, _ in spans][1:] == [b for _, _, b, _ in spans][:-1] and spans[-1][2] == len(data)
        assert all(b - a <= language.SEGMENT and f <= a and b <= t for f, a, b, t in spans)
        for _, a, b, _ in spans:
            bytes(data[a:b]).decode()


def test_held_out_accuracy_and_contract(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r for r in language.identify_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == docs.count()
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def trained():
    english = "the cat sat on the mat and then it went to the house of their friend with some of the others who were there "
    chinese = "今天天气很好我们一起去公园散步然后回家吃饭大家都很高兴明天还要继续工作学习新的知识希望一切顺利"
    net = language.ByteNet(["en", "zh"])
    net.fit([[language.bytes_of(english * 20)], [language.bytes_of(chinese * 20)]], steps=200, rows=64)
    return net, english, chinese


def test_digits_do_not_silence_a_sentence():
    net, _, chinese = trained()
    p = net.distributions([chinese[:20] + "2024" + chinese[20:] + " the", chinese, "1999 2000"])
    assert net.labels[int(p[0].argmax())] == "zh" and p[0].max() > 0.8 and p[2] is None


def test_pooling_is_the_mean_over_the_bytes_of_letters():
    net, english, chinese = trained()
    text = "hello wörld 12, " + "x" * 60 + english * 12 + chinese * 9
    data = language.bytes_of(text)
    p = net.distributions([text, None, "12 34", "", english])
    assert p[1:4] == [None, None, None]
    pooled = language.POOLED[data]
    sums, n = 0, 0
    for start, a, b, end in language.segments(data):
        q = net.probabilities(data[start:end, None])[a - start : b - start, 0]
        sums, n = sums + q[pooled[a:b]].sum(axis=0), n + pooled[a:b].sum()
    assert np.allclose(p[0], sums / n, atol=1e-5) and n == pooled.sum()
    assert len(net.positions(text)) == len(text.lower().encode())
    assert net.positions("") == []


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)} " * 30, f"l{i % 90}", None, 1) for i in range(360)]
    assert len(language.train(frame(spark, rows)).labels) == 90


def test_awkward_rows(spark):
    rows = documents()
    got = language.identify_languages(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[85].lang_pred == "und" and by[85].score == 0 and by[86].lang_pred == "und"
    assert by[0].lang_pred in {"en", "fr"}
    assert language.identify_languages(frame(spark, [])).count() == 0
    only = language.identify_languages(frame(spark, [(1, "abc", None, None, None)])).collect()
    assert only[0].lang_pred == "und"
