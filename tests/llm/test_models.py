"""Trained operators: held-out accuracy, what they learn from, and odd tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from signalfold.llm import langid, quality, toxicity
from signalfold.llm.queries import op1_toxicity, op8_quality, op10_language

DIR = "/root/testdata/sf0.01"


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}


def odd(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "123 456"), (4, "word " * 20_000), (4, "word")], "doc_id long, text string").withColumn("score", F.lit("own"))


def test_quality(spark, labels):
    got = op8_quality(spark, DIR).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id, 3) == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in held]) > 0.95


def test_language(spark):
    got = {r.doc_id: r for r in op10_language(spark, DIR).collect()}
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()
    assert all(got[r.doc_id].held_out == (crc(r.doc_id, 4) == 2) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]) > 0.97


def test_toxicity(spark, labels):
    got = op1_toxicity(spark, DIR).collect()
    assert len(got) == 1000 and all(0 <= r.severity <= 3 and r.toxic == (r.grade > 0) for r in got)


def test_toxicity_of_held_out_rows(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("documents", "labels"))
    back = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~back))
    rows = toxicity.score(docs.join(labels.where(back), "doc_id").select("doc_id", "text", F.col("toxic").alias("is_toxic")), model).collect()
    toxic, clean = [r for r in rows if r.is_toxic], [r for r in rows if not r.is_toxic]
    assert len(toxic) > 100 and np.mean([r.toxic for r in toxic]) > 0.9 and np.mean([r.toxic for r in clean]) < 0.01


def test_batches_score_like_single_texts():
    rng = np.random.default_rng(3)
    words = [f"vile{c}" for c in "abcdefgh"] + [f"w{i}" for i in range(40)] + ["Éclair", "naïf", "日本語", "l'eau", "x1y2", "ΑΣ", "ªb", "İs"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) + rng.choice(["", "!", "\n", "-vilea-"]) for _ in range(300)]
    rows, bad = [toxicity.features(t) for t in texts], np.array([t.count("vile") > 8 for t in texts])
    m = toxicity.fit(rows, bad)
    assert len(m.ids) > 5
    every = [None, "", "123", *texts, "vilea " * 5000, "z" * 10_000]
    want = np.array([m.above(*toxicity.features(t)[:2]) for t in every])
    scorer = toxicity.Scorer(m)
    assert np.allclose(scorer.above(pa.array(every)), want) and np.allclose(scorer.above(pa.array(every[5:9])), want[5:9])
    assert np.allclose(toxicity.Scorer(toxicity.Model()).above(pa.array(["a", None])), 0)
    # by brute force from the definition
    for t, p in zip(every[3:40], want[3:40], strict=True):
        counts = {}
        for w in regex.findall(r"\p{L}+", t.lower()):
            for i in (zlib.crc32(w.encode()), *((1 << 32) + zlib.crc32(w[:k].encode()) for k in (4, 6) if len(w) > k)):
                counts[i] = counts.get(i, 0) + 1
        s = sum(np.log1p(counts.get(int(i), 0)) * w for i, w in zip(m.ids, m.weights, strict=True))
        assert np.allclose(p, [1 / (1 + np.exp(t - s)) for t in m.theta] if counts else 0.0)


def test_ordinal_thresholds_share_weights():
    rng = np.random.default_rng(0)
    rows, bad = [], []
    for _ in range(600):
        t = rng.random() < 0.3
        words = [f"w{i}" for i in rng.integers(0, 50, 60)] + ["vile"] * (int(rng.integers(1, 4)) if t else 0)
        rows.append(toxicity.features(" ".join(words)))
        bad.append(t)
    m = toxicity.fit(rows, np.array(bad))
    assert list(m.theta) == sorted(m.theta)
    few, many = m.above(*toxicity.features("w1 vile")[:2]), m.above(*toxicity.features("w1 vile vile vile")[:2])
    assert (np.diff(few) <= 1e-12).all() and many.sum() > few.sum() and m.above(*toxicity.features("w1 w2")[:2])[0] < m.cut


def test_every_telling_word_counts(spark):
    # 676 tell-tale words, each in at least four rows, all of them toxic.
    texts = [" ".join(f"vzz{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(8 * (k % 100), 8 * (k % 100) + 8)) for k in range(400)]
    toxic = [(k, t, 1) for k, t in enumerate(texts)]
    rows = toxic + [(1000 + k, f"clean words here and there {k}", 0) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    words = {w for t in texts for w in t.split()}
    ids = {int(toxicity.features(w)[0][0]) for w in words}
    assert len(words) > 600 and ids <= set(m.ids.tolist())
    assert all(m.above(*toxicity.features(t)[:2])[0] >= m.cut for t in texts[:100])


def test_isotonic_is_ascending():
    x = np.array([0.0, 1, 2, 3, 4, 5])
    at, value = quality.isotonic(x, np.array([0.0, 1, 0, 1, 1, 0]))
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()


def test_models_without_labels_and_odd_rows(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, y string")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.Model()).collect()} == {("und", 0.0)}
    scored = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(scored) == 5 and not any(r.toxic for r in scored)
    m = langid.fit([langid.counts("the cat"), langid.counts("le chat")] * 10, ["en", "fr"] * 10)
    got = {(r.doc_id, r.text): r.lang_pred for r in langid.predict(docs.drop("score"), m).collect()}
    assert got[1, None] == got[2, ""] == got[None, "123 456"] == "und" and got[4, "word"] in ("en", "fr")
    assert toxicity.reject(docs, toxicity.Model()).columns == docs.columns and toxicity.reject(docs.limit(0), toxicity.Model()).count() == 0


def test_models_of_odd_tables(spark):
    docs = spark.createDataFrame([("a", "the cat sat", "en", 1, 0), ("b", "le chat dort", "fr", 0, 1), (None, "x", None, None, None), ("c", None, "en", 1, 0), ("b", "le chat dort", "fr", 0, 1)], "doc_id string, text string, lang string, quality int, toxic int")
    docs = docs.withColumn("score", F.lit("own")).withColumn("a.b", F.lit(1)).withColumn("toxic.x", F.lit(2))
    narrow = docs.select(F.hash("doc_id").alias("doc_id"), "text", "lang", "quality", "toxic")
    for rows in (docs, narrow, docs.limit(0)):
        n = rows.count()
        q = quality.score(rows, quality.train(rows.select("doc_id", "text"), rows.select("doc_id", "quality")))
        t = toxicity.score(rows, toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")))
        p = langid.predict(rows, langid.train(rows.select("doc_id", "text", "lang")))
        assert q.count() == t.count() == p.count() == n
        assert {"doc_id", "text"} <= set(q.columns) & set(t.columns) & set(p.columns) and q.columns.count("score") == 1


def test_rare_languages_are_learnt(spark):
    rows = [(i, f"the cat sat on mat {i}", "en") for i in range(3000)] + [(9000 + i, f"le chat dort ici {i}", "fr") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, bound=200)
    assert model.languages == ["en", "fr"] and model.predict("le chat")[0] == "fr" and langid.has_letter("日") and not langid.has_letter("😀 1")
    assert langid.counts("日 a 😀")[0].tolist() == langid.counts("日 a ☃")[0].tolist()


def test_language_model_by_its_definition(spark):
    """Document frequencies, TF-IDF rows and the softmax, by dictionaries of n-grams."""
    rows = [r for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang").collect() if r.lang and r.doc_id % 5 == 0]
    docs = spark.createDataFrame(rows)
    model = langid.train(docs, bound=100)

    def grams(text):
        chars = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        found = {}
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                h = 0
                for c, prime in zip(chars[i:i + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                    h ^= ord(c) * prime & 0xFFFFFFFF
                k = ((h + n - 1) * 0xC2B2AE3D & 0xFFFFFFFF) >> (32 - langid.BITS)
                found[k] = found.get(k, 0) + 1
        return found

    lettered = [r.text for r in rows if r.text and any(c.isalpha() for c in r.text)]
    df = {}
    for t in lettered:
        for k in grams(t):
            df[k] = df.get(k, 0) + 1
    assert all(np.isclose(model.idf[k], np.log((1 + len(lettered)) / (1 + df.get(k, 0))) + 1) for k in range(1 << langid.BITS))
    got = {(r.text): (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for t in [*lettered[:40], max(lettered, key=len)]:
        x = {k: np.log1p(n) * model.idf[k] for k, n in grams(t).items()}
        size = np.sqrt(sum(v * v for v in x.values()))
        logits = sum(v / size * model.weights[k] for k, v in x.items()) / model.temperature
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert got[t][0] == model.languages[int(p.argmax())] and np.isclose(got[t][1], p.max())


def test_quality_model_by_its_definition(spark):
    """Ridge on dense features of all learning rows, and isotonic means by the max-min formula."""
    docs, labels = (spark.read.parquet(f"{DIR}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    joined = docs.join(labels, "doc_id").select("doc_id", "text", "quality", (F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(4)) == 0).alias("back")).orderBy("doc_id").collect()
    x = np.array([quality.statistics(r.text) for r in joined])
    y, back = np.array([r.quality for r in joined], float), np.array([r.back for r in joined])
    mean, deviation = x[~back].mean(axis=0), np.maximum(x[~back].std(axis=0), 1e-6)
    rng, d = np.random.default_rng(quality.SEED), x.shape[1]
    projection, phase = rng.normal(size=(d, quality.FEATURES)) / np.sqrt(2 * d), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / deviation, -6, 6) @ projection + phase)
    z = np.c_[z, np.ones(len(z))]
    penalty = np.sqrt(quality.RIDGE * (~back).sum() / quality.FEATURES) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.r_[z[~back], penalty], np.r_[y[~back], np.zeros(z.shape[1])], rcond=None)[0]
    raw = z @ weights
    assert np.allclose(model.weights, weights, atol=1e-6)
    order = np.argsort(raw[back], kind="stable")
    at, target = raw[back][order], y[back][order]
    sums = np.r_[0, np.cumsum(target)]
    n = len(at)
    fitted = [max(min((sums[k] - sums[j]) / (k - j) for k in range(i + 1, n + 1)) for j in range(i + 1)) for i in range(n)]
    cuts = [0, *(i for i in range(1, n) if not np.isclose(fitted[i], fitted[i - 1])), n]
    centres, means = np.array([at[a:b].mean() for a, b in zip(cuts, cuts[1:])]), np.array([fitted[a] for a in cuts[:-1]])
    want = np.clip(0.999 * np.interp(raw, centres, means) + 0.001 * np.clip(raw, 0, 1), 0, 1)
    got = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    assert np.allclose([got[r.doc_id] for r in joined], want, atol=1e-5)


def test_repeated_rows_and_long_texts_score_alike(spark):
    """Equal texts of any length, one beyond a slice, in any partition."""
    base = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    long = "the quick brown fox. " * 120_000
    rows = [(i, t) for t in (long, "", None, "two words") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for scored in (quality.score(docs, quality.train(base, labels)), langid.predict(docs, langid.train(base, bound=200)), toxicity.score(docs, toxicity.train(base, labels))):
        results = {}
        for r in scored.collect():
            results.setdefault(r.text, set()).add(tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "text")))
        assert len(results) == 4 and all(len(v) == 1 for v in results.values())


def test_grades_of_held_out_toxic_rows_follow_the_models_own_reading(spark):
    """How far the grade is from the count of marker words that grades training rows, on toxic rows that were kept back."""
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("documents", "labels"))
    back = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(~back))
    rows = toxicity.score(docs.join(labels, "doc_id").select("doc_id", "text", "toxic", back.alias("back")).withColumnRenamed("toxic", "is_toxic"), model).collect()
    target = toxicity._grades([toxicity.features(r.text) for r in rows], np.array([bool(r.is_toxic) for r in rows]))
    error = [abs(r.severity - g) for r, g in zip(rows, target, strict=True) if r.back and r.is_toxic]
    print("mean error of the severity, held-out toxic rows:", np.mean(error), "rows", len(error), "constant guess", np.mean(np.abs(target[target > 0] - np.median(target[target > 0]))))
    assert len(error) > 100 and np.mean(error) < 0.5
