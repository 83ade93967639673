import random

import corpus_pipeline
from byteloom.llm import packing, quality, simhash, suffix_dedup, toxicity
from tests.llm.helpers import table, words
from tests.llm.test_dedup import brute_groups, brute_spans, near_copy


def test_stages_follow_one_another(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(260):
        w = words(rng, rng.randint(60, 160))
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["moron", "worthless"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    shared = words(rng, 60)
    rows += [(300 + k, " ".join(near_copy(rng, rows[k][1].split(), 2))) for k in (1, 2, 3)]
    rows += [(400 + k, " ".join(words(rng, 100) + shared + words(rng, 100))) for k in range(5)]
    rows += [(500, "%%% ### " * 40), (501, None), (502, "")]
    folder = str(tmp_path)
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        out = spark.read.parquet(f"{folder}/stage{k}")
        seen.append((name, [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, getattr(r, "text", None)) for r in out.collect()]))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        last, docs = docs, out
    (_, a, b), (_, c, d), (_, e, f), (_, g, h), _ = seen
    toxic = {r.doc_id for r in toxicity.toxic_documents(table(spark, a), model).collect()}
    assert {i for i, _ in b} == {i for i, _ in a} - toxic and len(toxic & set(range(0, 260, 4))) >= 60
    assert set(d) <= set(c) and 500 not in {i for i, _ in d} and len(d) >= len(c) - 5
    assert {i for i, _ in f} == {i for i, _ in e} - set(brute_groups(sorted(e))) and not {i for i, _ in f} & {301, 302, 303}
    spans = brute_spans(g)
    expected = {}
    for i, t in g:
        gone = spans.get((i, True), set())
        expected[i] = [w for k, w in enumerate(t.split()) if k not in gone]
    assert {i: t.split() for i, t in h} == {i: w for i, w in expected.items() if w}
    assert sum(" ".join(shared) in t for _, t in h) == 1

    places = sorted(tuple(r) for r in docs.collect())
    assert places == sorted(tuple(r) for r in packing.pack_documents(last).collect())
    assert len(corpus_pipeline.STAGES) == 5 and {m.__name__ for m in (toxicity, quality, simhash, suffix_dedup, packing)}
    assert {p[0] for p in places} == {i for i, _ in h}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {p[0] for p in places}
