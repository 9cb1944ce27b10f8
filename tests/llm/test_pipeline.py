import random

import corpus_pipeline as cp
from lattica.llm import bpe
from lattica.llm import decontamination as dc

from .tables import frame, words


def test_stages_take_effect(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").first().text
    good = [r.text for r in docs.where("lang = 'en'").orderBy("doc_id").limit(3).collect()]
    rng = random.Random(1)
    extra = [
        (9001, good[0] + " one more here", "en", "t", 1),
        (9002, " ".join(words(rng, 30)) + " " + bench + " " + good[1][: len(good[1]) // 2], "en", "t", 1),
        (9003, good[2][: len(good[2]) // 3] + " write to jane.doe@example.org now " + good[1][len(good[1]) // 2 :] + " " + good[0][len(good[0]) // 2 :], "en", "t", 1),
        (9004, None, None, None, None), (9005, "123 ... 456", "en", "t", 1), (9006, "", "en", "t", 0),
    ]
    now = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, data)
        path = str(tmp_path / name.replace(" ", "_"))
        now.write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in now.collect()}
        if name != cp.STAGES[-1][0]:
            assert now.columns == docs.columns
    first, second, third, fourth, last = kept.values()
    assert not {9004, 9005, 9006} & set(first) and {9001, 9002, 9003} <= set(first)
    assert len(first) >= 0.9 * docs.count()
    assert 9001 not in second and {9002, 9003} <= set(second)
    assert 9002 not in third and 9003 in third
    assert set(fourth) == set(third) and "jane.doe" not in fourth[9003].text and "[EMAIL]" in fourth[9003].text
    own = bpe.tokenizer(bpe.default_path())
    assert {d: r.n_tokens for d, r in last.items()} == {d: own.counts([r.text])[0] for d, r in fourth.items()}


def test_run_gives_the_stages_rows(spark, data):
    rows = cp.run(spark, data).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_leaks_by_a_basis_of_every_passage(spark, tmp_path, monkeypatch):
    """With one direction only, the basis is that of the words in three passages of four of long texts."""
    monkeypatch.setattr(dc, "RANK", 1)
    rng = random.Random(4)
    few, many = ([f"{c}{x}{i}" for i, x in enumerate(words(rng, 20))] for c in "yz")
    spark.createDataFrame([(1, " ".join(few)), (2, " ".join(many))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = []
    for d in range(30):  # of less than half of an item's words, so no leaks
        own = [rng.sample(few, 9), rng.sample(many, 9)]
        rows.append((d, " ".join(rng.choice(own[p % 4 > 0]) for p in range(128) for _ in range(dc.PASSAGE)), "en", "s", 1))
    fill = lambda: words(rng, 40)
    rows.append((100, " ".join(fill() + [x if i % 3 else "other" for i, x in enumerate(many)] + fill()), "en", "s", 1))
    kept = cp.drop_benchmark_leaks(spark, frame(spark, rows), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == set(range(30))
