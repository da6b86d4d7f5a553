"""The corpus pipeline against a plain version of its stages on a small table."""

import random

import pytest

from .test_operators import edit_distance, odd_documents, prose, tiny  # noqa: F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(31)
    item = prose(rng, 25)
    rows, labels = [], []
    for d in range(240):
        text = prose(rng, 90)
        if d % 12 == 0:
            text = "!! ".join(text.upper().split())  # junk
        elif d % 12 == 1:
            text += " " + item  # a leak
        elif d % 12 == 2:
            w = rows[d - 1 if d == 2 else d - 9][1].split()  # a near copy of an earlier text
            w[rng.randrange(len(w))] = rng.choice(w)
            text = " ".join(w)
        rows.append((d, text, "en", "hot" if d % 3 else f"s{d % 4}"))
        if d % 2 == 0 and d % 12 != 2:
            labels.append((d, int(d % 12 != 0), 0))
    odd_documents(spark, rows).write.parquet(at + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(at + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(at + "/benchmark.parquet")
    return at, rows, item


def test_pipeline(spark, tables):
    at, rows, item = tables
    columns = spark.read.parquet(at + "/documents.parquet").columns
    docs = spark.read.parquet(at + "/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, at)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns
    text = {d: t.lower().replace("!", "").split() for d, t, *_ in rows}
    # Quality: all junk goes, clean texts stay.
    clean = {d for d in text if d % 12}
    assert not {d for d in text if d % 12 == 0} & seen["quality"] and len(seen["quality"] & clean) >= 0.97 * len(clean)
    # Near copies: the lowest of each group of all pairs at 0.8, joined transitively.
    ids = sorted(seen["quality"])
    label = {d: d for d in ids}
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(set(text[a]) & set(text[b])) > 0.5 * len(set(text[a])) and edit_distance(text[a], text[b]) <= int(0.2 * max(len(text[a]), len(text[b])) + 1e-9)]
    for _ in range(5):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert seen["near_copies"] == {d for d in ids if label[d] == d}
    # Leaks: the texts with the item go, all others stay.
    words = " ".join(item.split())
    assert seen["leaks"] == {d for d in seen["near_copies"] if words not in " ".join(text[d])}
    # Weights and shards lose nothing.
    assert seen["weights"] == seen["leaks"] == seen["shards"]
    out = corpus_pipeline.run(spark, at)
    assert {r.doc_id for r in out.collect()} == seen["shards"] and out.where("shard is null").count() == 0


def test_shards_keep_the_order_of_the_mix(spark, tables, tmp_path):
    at = tables[0]
    docs = spark.read.parquet(at + "/documents.parquet")
    mixed = corpus_pipeline.weights(spark, docs, at)
    want = [r.doc_id for r in mixed.collect()]
    mixed.write.parquet(str(tmp_path / "mixed"))
    shard = {}
    for before in (mixed, spark.read.parquet(str(tmp_path / "mixed"))):
        out = corpus_pipeline.shards(spark, before, at).collect()
        shard = shard or {r.doc_id: r.shard for r in out}
        assert [r.doc_id for r in sorted(out, key=lambda r: r.place)] == want and sorted(r.place for r in out) == list(range(len(want)))
        assert [(r.shard, r.place) for r in out] == sorted((r.shard, r.place) for r in out)
        assert {r.doc_id: r.shard for r in out} == shard
    # Without the mix another order would come out.
    plain = corpus_pipeline.shards(spark, docs, at).collect()
    assert [r.doc_id for r in sorted(plain, key=lambda r: r.place)] != want


def test_pipeline_stands_odd_tables(spark, tiny):  # noqa: F811
    assert corpus_pipeline.run(spark, tiny).count() > 0
