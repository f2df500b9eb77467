"""Pair classifier, text embedder, terms and sorted segments: against dense fits and brute force."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import classify as K
from loomgraph.operators import pair_classifier as C
from loomgraph.operators import terms as T
from loomgraph.operators import text_embedder as E
from loomgraph.operators.tables import cut
from loomgraph.sources import segments


def dense_fit(x, y, k, ridge=1.0):
    """Newton once more, by the definition, on one matrix; features are scaled as in the library."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-12] = 1
    x = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    d, hit = x.shape[1], np.eye(k)[y]
    w, penalty = np.zeros((k - 1, d)), np.tile(np.r_[0, np.full(d - 1, ridge)], k - 1)
    for _ in range(60):
        z = np.hstack([np.zeros((len(x), 1)), x @ w.T])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = np.concatenate([(hit - p)[:, c] @ x for c in range(1, k)]) - penalty * w.ravel()
        h = np.block([[(x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x for b in range(1, k)] for a in range(1, k)]) + np.diag(penalty + 1e-12)
        w = w + np.linalg.solve(h, g).reshape(k - 1, d)
    return np.vstack([np.zeros(d), w]), mean, scale


def test_pair_model_equals_a_dense_fit(spark):
    from loomgraph.plans.learned import TYPES, part_pairs

    rows = part_pairs(spark, "/root/testdata/sf0.001")
    model = C.fit(rows.where("not held_out").repartition(5), TYPES)
    local = rows.collect()
    taught = [r for r in local if not r.held_out]
    w, mean, scale = dense_fit(np.array([r.x for r in taught]), np.array([model.classes.index(r.label) for r in taught]), len(model.classes))
    assert set(model.classes) == {r.label for r in taught} and [c for c in TYPES if c in model.classes] == list(model.classes)
    assert np.abs(model.weights - w).max() < 1e-6 and np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    got = model.classified(rows, F.col("x")).collect()
    assert abs(sum(r.rel_type == r.label for r in got if r.held_out) / sum(r.held_out for r in got)) > 0.75
    answers = model.classifier()([{"x": r.x} for r in got[:50]])
    assert [(a["rel_type"], round(a["confidence"], 9)) for a in answers] == [(r.rel_type, round(r.confidence, 9)) for r in got[:50]]


def test_pair_model_behind_the_cache_and_odd_rows(spark):
    classes = ("none", "a", "b")
    rows = [([float(k % 3), float(k % 2)], (*classes, None, "other")[k % 5]) for k in range(60)]
    model = C.fit(spark.createDataFrame(rows, "x array<double>, label string"), classes)
    pairs = spark.createDataFrame([("k1", [0.0, 0.0]), ("k2", [2.0, 1.0]), ("k2", [2.0, 1.0])], "key string, x array<double>")
    cache = spark.createDataFrame([("k1",)], "key string")
    fresh = K.classify_misses(pairs, cache, model.classifier(), classes).collect()
    assert [r.key for r in fresh] == ["k2"] and fresh[0].error is None and fresh[0].rel_type in classes
    with pytest.raises(ValueError):
        C.fit(spark.createDataFrame([([1.0], "other")], "x array<double>, label string"), classes)
    texts = spark.createDataFrame([("Gaya Gerak", "gaya", 0.5, "x", "y"), (None, "", None, None, "y"), ("a", " A ", 1.0, "x", "x")], "a string, b string, s double, ga string, gb string")
    x = [dict(zip(C.FEATURES, r.x, strict=True)) for r in texts.select(C.features(F.col("a"), F.col("b"), F.col("s"), F.col("ga"), F.col("gb")).alias("x")).collect()]
    assert x[0] == {"score": 0.5, "common": 1.0, "jaccard": 0.5, "contained": 1.0, "equal": 0.0, "length_gap": math.log1p(6), "other_group": 1.0}
    assert x[1]["equal"] == x[1]["contained"] == x[1]["score"] == x[1]["other_group"] == 0.0 and x[2]["equal"] == 1.0 and x[2]["other_group"] == 0.0


def test_embedder_equals_a_dense_decomposition(spark):
    rnd = random.Random(3)
    topics = [[f"t{t}w{k}" for k in range(12)] for t in range(9)]
    docs = [" ".join(rnd.choice(topics[k % 9]) if rnd.random() < 0.8 else f"noise{rnd.randrange(60)}" for _ in range(30)) for k in range(500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)] + [(500, None), (501, "  ")], "id long, text string").repartition(6)
    model = E.fit(df, 9, passes=12, columns=512)
    a = model.rows(docs)
    v = np.linalg.svd(a, full_matrices=False)[2][:9].T
    want = a @ v
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r.id: r.vector for r in E.embedded(df, model).collect()}
    mine = np.array([got[k] for k in range(500)])
    assert np.abs(mine @ mine.T - want @ want.T).max() < 1e-4 and got[500] == got[501] == [0.0] * 9
    seen = Counter(c for d in docs for c in set(E.columns_of(d, 512)[0].tolist()))
    assert all(abs(model.idf[c] - (math.log(503 / (1 + n)) + 1)) < 1e-12 for c, n in seen.items())
    cache = spark.createDataFrame([], "key string, model string, vector array<float>")
    first = K.embed_misses(df.where("id < 3"), cache, "tfidf", model).cache()
    assert first.count() == 3 and np.allclose(sorted(map(list, (r.vector for r in first.collect()))), sorted(got[k] for k in range(3)))
    assert K.embed_misses(df.where("id < 3"), first, "tfidf", model).count() == 0
    assert E.fit(df.where("false"), 4)(["x"]) == [[0.0] * 4]


def brute_terms(texts, stop, least):
    n = Counter()
    for t in texts:
        for s in re.split(r"[.,;:!?()\x0a-\x0d]+", (t or "").lower()):
            w = [x for x in re.split(r"[ \t]+", s) if x]
            n.update(tuple(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1))
    n = {w: c for w, c in n.items() if c >= least and w[0] not in stop and w[-1] not in stop}
    out = set()
    for w, c in n.items():
        longer = [m for v, m in n.items() if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        value = math.log2(len(w)) * (c - (sum(longer) / len(longer) if longer else 0))
        if value > 0:
            out.add((" ".join(w), len(w), c, len(longer), round(value, 9)))
    return out


def test_terms_equal_brute_force(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["gaya", "gerak", "listrik", "yang", "medan", "magnet", "kuat.", "(arus", "\n", "di", "  "]) for _ in range(60)) for _ in range(40)] + [None, "", "satu"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for stop in ((), ("yang", "di")):
        got = {(r.phrase, r.words, r.n, r.nested, round(r.c_value, 9)) for r in T.extracted_terms(df, stopwords=stop, least=5).collect()}
        assert got == brute_terms(texts, stop, 5) and got
    assert T.extracted_terms(df.where("false")).count() == 0
    run = T.term_extractor({"gaya gerak listrik", "gaya gerak", "medan magnet"})
    assert [c["name"] for c in json.loads(run("Gaya gerak listrik, gaya gerak. medan\nmagnet medan magnet"))["concepts"]] == ["gaya gerak listrik", "gaya gerak", "medan magnet"] and json.loads(run(None)) == {"concepts": []}


def test_a_prefix_opens_only_its_segments(spark, tmp_path):
    keys = [f"{p}:{k:03}" for p in ("course", "progress", "progress2", "review", "é") for k in range(200)] + ["progress", "a", "zz"]
    rows = spark.createDataFrame([(k, f"v{k}") for k in keys] + [(None, "lost"), ("progress:001", "again")], "key string, value string").repartition(4)
    path = str(tmp_path / "kv")
    segments.write_segments(rows, path, 20)
    every = len(spark.read.parquet(f"{path}/segments").inputFiles())
    assert every > 12
    for prefix in ("progress:", "progress", "course:0", "é:19", "zz", "zzz", "b", "", "progress:001"):
        found = segments.scan_prefix(spark, path, prefix)
        assert sorted(r.key for r in found.collect()) == sorted(k for k in [*keys, "progress:001"] if k.startswith(prefix)), prefix
    assert len(segments.scan_prefix(spark, path, "progress:00").inputFiles()) <= 3 and len(segments.scan_prefix(spark, path, "").inputFiles()) == every
    assert segments.scan_prefix(spark, path, "b").inputFiles() == [] or segments.scan_prefix(spark, path, "b").count() == 0
    assert sorted(r.value for r in segments.get(spark, path, "progress:001").collect()) == ["again", "vprogress:001"]
    plan = segments.scan_prefix(spark, path, "progress:")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,progress:)" in plan


def test_a_bundle_of_tables(spark, tmp_path):
    from loomgraph.operators import feedback as R

    tables = {
        "ratings": spark.createDataFrame([("a", 'say "x",\ny', 1.5, ["p", "q"]), ("b", None, None, None)], "reviewer string, comment string, score double, tags array<string>"),
        "none": spark.createDataFrame([], "id long"),
    }
    path = str(tmp_path / "bundle")
    assert [tuple(r) for r in R.write_bundle(tables, path, "Results").collect()] == [("ratings", 2, "reviewer, comment, score, tags"), ("none", 0, "id")]
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/ratings").orderBy("reviewer").collect()
    assert [tuple(r) for r in back] == [("a", 'say "x",\ny', "1.5", '["p","q"]'), ("b", None, None, None)]
    page = "\n".join(r.value for r in spark.read.text(f"{path}/README").collect())
    assert page.startswith("## Results") and "| ratings | 2 | reviewer, comment, score, tags |" in page


def test_chances_are_plain_arithmetic_and_names_are_keyed_once(spark):
    model = C.PairModel(("p", "q", "r"), np.array([[0.0, 0, 0], [0.3, -1.2, 0.7], [-0.4, 0.9, 2.1]]), np.array([0.5, -0.25]), np.array([2.0, 0.5]))
    x = [[0.1, 0.2], [1.5, -3.0], [-2.0, 4.0]]
    df = model.classified(spark.createDataFrame([(v,) for v in x], "x array<double>"), F.col("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "aggregate(" not in plan
    want = model.classifier()([{"x": v} for v in x])
    assert [(r.rel_type, round(r.confidence, 12)) for r in df.collect()] == [(w["rel_type"], round(w["confidence"], 12)) for w in want]
    names = spark.createDataFrame([(" A  b", "b a", 0.5), (None, "c", None)], "a string, b string, s double")
    none = F.lit(None).cast("string")
    both = names.select(C.features(F.col("a"), F.col("b"), F.col("s"), none, none).alias("x"), C.features(C.key(F.col("a")), C.key(F.col("b")), F.col("s"), none, none, keyed=True).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both]


def test_phrases_of_texts_in_one_piece_are_counted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "TASK_TEXTS", 3)
    texts = spark.createDataFrame([("aa bb cc dd ee. aa bb",)] * 20 + [("aa",), ("",), (None,)], "text string").coalesce(1)
    counted = T.phrases(texts, stopwords=())
    assert "RoundRobinPartitioning(8)" in counted.select("*")._jdf.queryExecution().executedPlan().toString()
    want = {"aa bb": 40, **dict.fromkeys(["bb cc", "cc dd", "dd ee", "aa bb cc", "bb cc dd", "cc dd ee", "aa bb cc dd", "bb cc dd ee"], 20)}
    assert {r.phrase: r.n for r in counted.collect()} == want
    words = [f"w{k}" for k in range(3000)]  # one sentence
    long = T.phrases(spark.createDataFrame([(" ".join(words),)], "text string"), stopwords=()).collect()
    assert {r.phrase for r in long} == {" ".join(words[i : i + n]) for n in (2, 3, 4) for i in range(3001 - n)}


def test_texts_are_split_once(spark, monkeypatch):
    docs = [(1, "a b  b\tC"), (2, None), (3, ""), (4, "c\n A"), (5, "x y z " * 400)]
    d = spark.createDataFrame(docs, "id long, text string")
    table = cut(E.counted(d, "id", columns=64))
    want = {i: [x.tolist() for x in E.columns_of((t or "").lower(), 64)] for i, t in docs}
    assert {r.id: [r["at"], r["n"]] for r in table.collect()} == want
    monkeypatch.setattr(E, "counted", None)  # neither the fit nor the vectors go back to the texts
    model = E.fit_counted(table, 2, passes=2, columns=64)
    got = {r.id: r.vector for r in E.embedded_counted(table, model).collect()}
    assert all(np.allclose(got[i], model([t])[0], atol=1e-6) for i, t in docs)
