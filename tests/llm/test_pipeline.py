"""The pipeline's stages: each acts on its own input and keeps clean documents."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from signalfold.llm import toxicity
from tests.llm.test_text_operators import brute_components, brute_windows

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert sorted(out.columns) == sorted(docs.columns), name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    last = P.STAGES[-1][1](spark, docs, DIR)
    assert last.count() == sizes[-1] and last.where("size(ids) <> n_tokens").isEmpty()
    assert P.run(spark, DIR).select("doc_id").exceptAll(last.select("doc_id")).isEmpty()


def test_stages_keep_what_brute_force_keeps(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    leak = next(t for _, t in bench if len(t.split()) > 12)
    own = [f"w{i} " * 3 + " ".join(f"x{i}y{j}" for j in range(60)) for i in range(4)]
    planted = [own[0], own[0].replace(" ", "\n"), own[0] + "  ", own[1], own[1].replace("x1y30", "other"), own[2] + " end", own[2], "so " + leak + " it is", own[3], None, ""]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(planted)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True).localCheckpoint()
    stages = dict(P.STAGES)

    def held(name):
        return sorted(r.doc_id for r in stages[name](spark, docs, DIR).select("doc_id").collect())

    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)

    model = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    clean = [i for i in ids if model.above(*toxicity.features(texts[i])[:2])[0] < model.cut]
    assert held("toxicity") == clean and len(clean) < len(ids)

    best = {}
    for i in ids:
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i] or ""), []).append(i)
    single = sorted(min(g, key=lambda i: (-len(texts[i] or ""), i)) for g in best.values())
    assert held("exact dedup") == single and len(single) < len(ids)

    place = brute_components([texts[i] for i in ids], 5, 80)
    apart = [i for k, i in enumerate(ids) if place[k][2]]
    assert held("near dedup") == apart and len(apart) < len(single)

    found = brute_windows([texts[i] for i in ids], bench)
    unseen = [i for k, i in enumerate(ids) if not found[k][1]]
    assert held("decontamination") == unseen and len(unseen) < len(ids)


def test_stages_of_odd_tables(spark):
    own = [" ".join(f"x{i}y{j}" for j in range(60)) for i in range(3)]
    texts = [None, "", " ", own[0], own[0], own[0] + "  ", own[1], "z" * 50_000, own[2], own[2].replace("x2y30", "other")]
    ids = [1, 2, None, 3, 3, 4, None, 5, 7, 6]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id int, text string").withColumns(
        {"lang": F.lit("en"), "sha": F.lit(1), "kept": F.lit("own"), "ids": F.lit("own"), "a.b": F.lit(2), "__row": F.lit(3), "n": F.lit(4), "_metadata": F.lit(5)})
    left = {"toxicity": 10, "exact dedup": 6, "near dedup": 8, "decontamination": 10, "bpe": 10}
    for name, stage in P.STAGES:
        got = stage(spark, docs, DIR)
        assert got.count() == left[name] and stage(spark, docs.limit(0), DIR).count() == 0, name
        assert set(got.columns) == set(docs.columns) if name != "bpe" else set(docs.columns) - {"text"} < set(got.columns), name
