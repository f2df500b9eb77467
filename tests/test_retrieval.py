"""Neighbours, plans, classification, sources, streaming and iterative operators."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import candidates as C
from loomgraph.operators import classify as K
from loomgraph.operators import compare as P
from loomgraph.operators import context as X
from loomgraph.operators import feedback as R
from loomgraph.operators import metrics as M
from loomgraph.operators import paths as G
from loomgraph.operators import acyclic as Y
from loomgraph.operators import overlap as O
from loomgraph.operators import similarity as S
from loomgraph.operators import vector_index as V
from loomgraph.sources import files
from loomgraph.streaming import ratings


def vectors(spark, rows):
    return S.vectors(spark.createDataFrame(rows, "id string, v array<float>"), "id", "v")


ROWS = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)]


def test_ties_go_to_the_smaller_id_and_self_is_out(spark):
    v = vectors(spark, ROWS)
    got = {(r.source, r["rank"]): (r.target, r.score) for r in S.neighbours(v, v, 2).collect()}
    assert got["a", 1] == ("b", 1.0) and got["a", 2] == ("d", 1.0) and got["d", 1] == ("a", 1.0) and got["c", 1] == ("a", 0.5) and len(got) == 8
    live = S.neighbours(v, v, 2, self_in_k=True).groupBy("source").count().collect()
    assert max(r["count"] for r in live) <= 2 and S.neighbours(v, v, 1, raw=True).where("source = 'c'").first().score == 0.0


def test_blocks_give_what_the_broadcast_gives(spark, sf_dir, monkeypatch):
    v = S.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(200), "vec_id", "embedding")
    v = spark.createDataFrame(v.collect(), v.schema)
    want = sorted(map(tuple, S.neighbours(v, v, 3).collect()))
    ranks = sorted(map(tuple, S.ranks_of(S.neighbours(v, v, 3).select("source", "target", "score"), v, v).collect()))
    ties = sorted(map(tuple, S.neighbours(v, v, 5, ties=True).collect()))
    monkeypatch.setattr(V, "BLOCK", 30)
    assert sorted(map(tuple, S.neighbours(v, v, 3).collect())) == want
    assert sorted(map(tuple, S.ranks_of(S.neighbours(v, v, 3).select("source", "target", "score"), v, v).collect())) == ranks
    assert sorted(map(tuple, S.neighbours(v, v, 5, ties=True).collect())) == ties


def test_groups_and_competition_ranks(spark):
    rows = [(f"n{k}", [float(k % 5), 1.0, float(k % 3)], ("x", "y", "", None)[k % 4]) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, v array<float>, grade string")
    v = S.vectors(df, "id", "v").join(df.select("id", "grade"), "id")
    every = S.neighbours(v, v, 39)
    better = {(r.source, r.target): r["rank"] for r in S.competition_rank(every.drop("rank")).collect()}
    assert {(r.source, r.target): r["rank"] for r in S.neighbours(v, v, 4, ties=True).collect()} == {p: n for p, n in better.items() if n <= 4}
    assert {(r.source, r.target): r["rank"] for r in S.ranks_of(every.select("source", "target", "score"), v, v).collect()} == better
    grade = {i: g for i, _, g in rows}
    wanted = S.top_after_filter(every.drop("rank").join(df.select(F.col("id").alias("source"), F.col("grade").alias("source_grade")), "source").join(df.select(F.col("id").alias("target"), F.col("grade").alias("target_grade")), "target"), C.across_grades(), 3)
    got = {(r.source, r["rank"]): r.target for r in S.neighbours(v, v, 3, group="grade").collect()}
    assert got == {(r.source, r["rank"]): r.target for r in wanted.collect()} and all(grade[s] in ("x", "y") for s, _ in got)


def test_scopes(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9), ("a", "c", 0.8), ("a", "d", 0.7)], "source string, target string, score double")
    grades = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "X"), ("d", "")], "id string, grade string")
    run = lambda scope, sel=None: {(r.a, r.b) for r in C.candidate_pairs(pairs, grades, 0.7, scope, sel).collect()}
    assert run("all") == {("a", "b"), ("a", "c"), ("a", "d")} and run("cross_all") == {("a", "b")} and run("single", "X") == {("a", "c")} and run("cross", "Z") == set()
    with pytest.raises(ValueError):
        run("single")


def test_plans_prune_and_push(spark, sf_dir):
    from loomgraph import plans  # noqa: F401
    from loomgraph.catalog import QUERIES

    plan = lambda df: df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan(QUERIES["candidate_pairs"](spark, sf_dir))
    for name in ("merge_last_wins", "consensus_action", "method_overlap", "shared_variable_pairs"):
        assert "CartesianProduct" not in plan(QUERIES[name](spark, sf_dir)), name
    li = plan(QUERIES["direction_share"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in li and "l_comment" not in li


def test_nested_sweeps_and_metrics_edges(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    assert P.nested(a.limit(0), a) and not P.nested(a, a.where("x = 1"))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "b")], "src string, dst string")
    assert {(r.id, r.degree) for r in M.degrees(nodes, edges, True).collect()} == {("a", 1), ("b", 1), ("c", 0)}
    assert {(r.id, r.degree) for r in M.degrees(nodes, edges).collect()} == {("a", 5), ("b", 3), ("c", 0)}
    one = nodes.withColumn("part", F.lit(1))
    assert M.modularity(edges, one).first().q == 0.0
    assert {r.id: r.component for r in G.connected_components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "c"}
    ring = spark.createDataFrame([("a", "b", 3), ("b", "c", 2), ("c", "a", 1), ("a", "a", 9)], "src string, dst string, w int")
    assert {(r.src, r.dst): r.accepted for r in Y.accept_acyclic(ring, [F.desc("w")]).collect()} == {("a", "b"): True, ("b", "c"): True, ("c", "a"): False, ("a", "a"): False}
    seeded = Y.accept_acyclic(ring, [F.desc("w")], spark.createDataFrame([("b", "a")], "src string, dst string"))
    assert {(r.src, r.dst): r.accepted for r in seeded.collect()} == {("a", "b"): False, ("b", "c"): True, ("c", "a"): True, ("a", "a"): False}
    assert G.reachable(ring, spark.createDataFrame([("b",)], "src string")).count() == 3


def test_kappa_and_consensus_edges(spark):
    same = spark.createDataFrame([("x", "x")] * 3, "rating_a string, rating_b string")
    assert R.cohen_kappa(same).first().kappa == 1.0
    tie = spark.createDataFrame([(1, "wrong", "r1"), (1, "correct", "r2")], "item int, rating string, reviewer string")
    row = R.consensus(tie, "item").first()
    assert (row.consensus, row.action, row.n_reviewers) == ("correct", "keep", 2)
    assert R.precision_recall(tie.limit(0), "item").count() == 0 and "| item |" in R.report_lines("t", tie.select("item"))


def test_classification_computes_misses_only_and_isolates_failures(spark):
    pairs = spark.createDataFrame([("k1", "Sel", "sel", 0.9), ("k2", "Sel", "Gaya", 0.75), ("k3", "x", "y", 0.1)], "key string, name_a string, name_b string, score double")
    cache = spark.createDataFrame([("k2", "APLIKASI_DARI", 0.8, "cached")], "key string, rel_type string, confidence double, description string")
    classes = ("SAMA_DENGAN", "APLIKASI_DARI", "BERKAITAN_DENGAN")
    fresh = K.classify_misses(pairs, cache, K.rule_classifier, classes)
    assert {r.key for r in fresh.collect()} == {"k1", "k3"}
    out = {r.key: (r.rel_type, r.cached) for r in K.classified(pairs, cache, fresh).collect()}
    assert out == {"k1": ("SAMA_DENGAN", False), "k2": ("APLIKASI_DARI", True), "k3": ("none", False)}

    def broken(rows):
        raise RuntimeError("bad request")

    failed = K.classify_misses(pairs, cache, broken, classes).collect()
    assert {(r.rel_type, r.confidence, r.error) for r in failed} == {("none", 0.0, "bad request")}
    wild = K.classify_misses(pairs, cache, lambda rows: [{"pair_index": 0, "rel_type": "SAMA_DENGAN", "confidence": 7}], classes, batch=2).collect()
    assert sorted((r.rel_type, r.confidence) for r in wild) == [("SAMA_DENGAN", 1.0), ("none", 0.0)]


def test_retries_only_transient_errors():
    waits, calls = [], []

    def flaky(items):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 429")
        return items

    assert K.retried(flaky, first_wait=1, longest=1.5, sleep=waits.append)([1]) == [1] and waits == [1, 1.5]
    with pytest.raises(ValueError):
        K.retried(lambda items: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)([1])


def test_embedding_cache_and_extraction(spark):
    texts = spark.createDataFrame([("a b",), ("c",), ("a b",), (None,)], "text string")
    empty = spark.createDataFrame([], "key string, model string, vector array<float>")
    first = K.embed_misses(texts, empty, "m", K.hashing_embedder(8))
    first = spark.createDataFrame(first.collect(), first.schema)
    assert first.count() == 2 and K.embed_misses(texts, first, "m", K.hashing_embedder(8)).count() == 0 and K.embed_misses(texts, first, "m2", K.hashing_embedder(8)).count() == 2
    docs = spark.createDataFrame([("1", "Sel dan Inti"), ("2", "x")], "id string, text string")
    good = K.extract(docs, K.keyword_extractor, "concepts array<struct<name:string>>").collect()
    assert [c.name for c in good[0].parsed.concepts] == ["Sel", "Inti"] and good[0].error is None
    assert {r.error for r in K.extract(docs, lambda t: "no json", "concepts array<struct<name:string>>").collect()} <= {"not JSON", None}
    cache = spark.createDataFrame([("k", "v1", "2026-01-01")], "key string, value string, written string")
    put = K.cache_put(cache, spark.createDataFrame([("k", "v2", "2026-02-01", None), ("e", "x", "2026-02-01", "failed")], "key string, value string, written string, error string"))
    assert [tuple(r) for r in put.collect()] == [("k", "v2", "2026-02-01")] and K.cache_maintenance(put, "2026-03-20", 30).count() == 0


def _host(x, best):
    while best[best[x][1]][1] != x:
        x = best[x][1]
    return min(x, best[x][1])


def _greedy(ids, pairs):
    part, m, last = {i: i for i in ids}, len(pairs), None
    while m:
        w, d = {}, {}
        for a, b in pairs:
            for x, y in ((part[a], part[b]), (part[b], part[a])):
                w[x, y] = w.get((x, y), 0) + 1
                d[x] = d.get(x, 0) + 1
        score = sum(2 * m * w.get((x, x), 0) - d[x] ** 2 for x in d)
        if last and score <= last[0]:
            part = last[1]
            break
        last, best = (score, part), {}
        for (x, y), n in w.items():
            if x != y and 2 * m * n > d[x] * d[y]:
                best[x] = min(best.get(x, (1, "")), (d[x] * d[y] - 2 * m * n, y))
        if not best:
            break
        part = {i: _host(p, best) if p in best else p for i, p in part.items()}
    least = {p: min(i for i in part if part[i] == p) for p in part.values()}
    part = {i: least[p] for i, p in part.items()}
    ends = [part[x] for p in pairs for x in p]
    return part, sum(part[a] == part[b] for a, b in pairs) / m - sum((ends.count(p) / (2 * m)) ** 2 for p in set(ends))


def test_greedy_communities(spark, sf_dir):
    import random

    from loomgraph import plans  # noqa: F401
    from loomgraph.catalog import QUERIES

    rnd = random.Random(4)
    ids = [f"v{k:02d}" for k in range(40)]
    pairs = sorted({tuple(sorted((a, b))) for a in ids for b in ids if a != b and rnd.random() < (0.5 if int(a[1:]) // 10 == int(b[1:]) // 10 else 0.02)})
    nodes, edges = spark.createDataFrame([(i,) for i in [*ids, "alone"]], "id string"), spark.createDataFrame([*pairs, ("v00", "v00"), pairs[0][::-1]], "src string, dst string")
    want, q = _greedy([*ids, "alone"], pairs)
    assert {r.id: r.part for r in G.greedy_communities(nodes, edges).collect()} == want and len(set(want.values())) < 12
    row = G.best_partition(nodes, edges).first()
    assert abs(row.q - q) < 1e-9 and row.q > 0.3 and row.communities == len(set(want.values()))
    row = QUERIES["communities"](spark, sf_dir).first()
    v = S.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    close = {tuple(sorted((r.source, r.target))) for r in S.neighbours(v, v, 10).where("score >= 0.65").collect()}
    want, q = _greedy([r.id for r in v.select("id").collect()], sorted(close))
    assert abs(row.q - q) < 1e-9 and row.communities == len(set(want.values()))


def test_ranges_beyond_the_broadcast(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    starts = spark.createDataFrame([(float(x), k) for k, x in enumerate(rnd.sample(range(3000), 500))], "start double, n int")
    points = spark.createDataFrame([(rnd.uniform(-50, 3100), k) for k in range(900)] + [(None, 900)], "at double, id int")
    want = sorted(map(str, G.assign_ranges(points, "at", starts, "start").collect()))
    monkeypatch.setattr(G, "BROADCAST_RANGES", 0)
    many = G.assign_ranges(points, "at", starts, "start")
    assert many.columns == ["at", "id", "start", "n", "_end"] and sorted(map(str, many.collect())) == want


def test_names_in_blocks(spark, monkeypatch):
    names = [(f"{a} {b}",) for a in ("gaya", "energi", "muatan") for b in ("listrik", "magnet", "gerak")] + [("Usaha",), ("",)]
    terms = [("Gaya Gerak",), ("magnet",), ("usaha dan energi",), ("tidak ada",), ("",)]
    e, f = spark.createDataFrame(terms, "term string"), spark.createDataFrame(names, "name string")
    monkeypatch.setattr(O, "HEAVY", 2)
    got = {r.term: (r.name, r.how) for r in X.match_terms(e, f).collect()}
    assert got == {"Gaya Gerak": ("gaya gerak", "exact"), "magnet": ("gaya magnet", "part"), "usaha dan energi": ("Usaha", "part"), "tidak ada": (None, "none"), "": ("", "exact")}


def test_transient_errors():
    assert all(map(K.transient, (ValueError("HTTP 429"), ValueError("503 Service Unavailable"), TimeoutError("timed out"))))
    assert not any(map(K.transient, (ValueError("length 1500"), ValueError("bad request 400"), KeyError("timeout"))))
    coded = ValueError("no words")
    coded.status_code = 502
    assert K.transient(coded)
    coded.status_code = 400
    assert not K.transient(coded)


def test_vocabularies_decide_what_is_stored(spark):
    df = spark.createDataFrame([("SAMA_DENGAN", 0.9), ("none", 0.9), ("supports", 0.9), ("SAMA_DENGAN", None)], "t string, c double")
    for name, want in (("a", [None, None, "supports", None]), ("b", ["LINTAS_BUKU_SAMA_DENGAN", None, None, None])):
        ontology, classes, stored = K.for_schema(name)
        assert ontology.name == name and "none" in classes
        assert [r[0] for r in df.select(stored(F.col("t"), F.col("c"))).collect()] == want


def test_context(spark):
    edges = spark.createDataFrame([("a", "x", "T", 0.9), ("a", "y", "T", None), ("b", "x", "U", 0.5)], "src string, dst string, rel_type string, confidence double")
    nodes = spark.createDataFrame([("a", "A", ""), ("b", "B", None)], "id string, name string, description string")
    chapters = spark.createDataFrame([("a", "Bab 1")], "id string, chapter string")
    row = X.with_context(spark.createDataFrame([("a", "b")], "a string, b string"), nodes, chapters, edges).first()
    assert row.shared == ["x"] and [e.target for e in row.out_edges_a] == ["x", "y"] and row.chapter_b is None
    pool = X.context_pool([spark.createDataFrame([("b", "Sel")], "book string, name string"), spark.createDataFrame([("b", "SEL"), ("b", "Inti")], "book string, name string")], 2)
    assert {(r.name, r["rank"]) for r in pool.collect()} == {("Sel", 1), ("Inti", 2)}
    heads = X.chapter_of_header(spark.createDataFrame([("b", "bab sel dan inti")], "book string, header string"), spark.createDataFrame([("b", "Sel dan Jaringan"), ("b", "Gerak")], "book string, chapter string"))
    assert heads.first().chapter == "Sel dan Jaringan"


def test_sources(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "Ahli-1__Biologi.json").write_text(json.dumps({"ratings": {"0": "correct", "x": "wrong"}, "comments": {}}))
    (tmp_path / "r" / "Kimia.json").write_text(json.dumps({"ratings": {"3": "partial"}}))
    rev = files.reviews(spark, str(tmp_path / "r"))
    assert {(r.reviewer, r.course) for r in rev.collect()} == {("ahli-1", "Biologi"), ("default", "Kimia")}
    assert {(r.reviewer, r["index"]) for r in R.rating_rows(rev).collect()} == {("ahli-1", 0), ("default", 3)}
    (tmp_path / "s.csv").write_text("﻿id,konsep_A\nLB001,\"a, b\"\n", encoding="utf-8")
    assert files.survey(spark, str(tmp_path / "s.csv")).first().asDict() == {"id": "LB001", "konsep_A": "a, b"}
    (tmp_path / "d.json").write_text(json.dumps({"version": "1", "edges": [{"rel_type": "T", "source_name": "a"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"rel_type": "U", "source_name": "b"}]))
    assert [r.rel_type for p in ("d", "l") for r in files.edge_dump(spark, str(tmp_path / f"{p}.json")).collect()] == ["T", "U"]
    kv = spark.createDataFrame([("p:r1:Bio", '{"ratings": {"1": "wrong"}}'), ("p:r2:Bio", "broken"), ("q:x", "{}")], "key string, value string")
    assert [(r.reviewer, r.course) for r in files.key_values(kv, "p:").collect()] == [("r1", "Bio")]
    assert files.connection("graph", {"host": ""}, {"host": "h", "port": "1"}, {"GRAPH_PORT": "2"}) == {"host": "h", "port": "2"} and files.latest(["s/2026-01", "s/2026-03"]) == "s/2026-03"
    (tmp_path / "b.bin").write_bytes(b"one\ftwo")
    assert [(r.book, r.page, r.text) for r in files.pages(spark, str(tmp_path / "b.bin"), lambda c: c.decode().split("\f")).collect()] == [("b", 1, "one"), ("b", 2, "two")]
    assert files.listing(spark, str(tmp_path), "*.json").count() == 4


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    src = tmp_path / "in"
    events.union(events.where("event_id % 10 = 0")).repartition(1).write.parquet(str(src))
    stream = ratings.windowed_counts(ratings.rated(ratings.read(spark, str(src))), delay="4000 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.start, r.rating): r.n for r in ratings.windowed_counts(ratings.rated(events)).collect()}
    assert {(r.start, r.rating): r.n for r in spark.table("counts").collect()} == want
    m = ratings.merge_into(ratings.rated(ratings.read(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp2"))
    m.awaitTermination(120)
    assert ratings.merged(spark, str(tmp_path / "out")).count() == events.count()
    assert ratings.sessions(ratings.rated(events)).agg(F.sum("n")).first()[0] == events.count()
