"""Acyclic filter, chains, overlap and containment joins, order statistics, vector index: against brute force."""

import graphlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import plans  # noqa: F401  registers the queries
from loomgraph.catalog import ORACLES
from loomgraph.operators import acyclic as Y
from loomgraph.operators import context as X
from loomgraph.operators import metrics as M
from loomgraph.operators import overlap as O
from loomgraph.operators import paths as P
from loomgraph.operators import similarity as S
from loomgraph.operators import vector_index as V
from loomgraph.operators.order_statistics import values_at


def sequential(edges, seed=()):
    """(src, dst) -> accepted by a fresh search for each edge."""
    after, out = {}, {}
    for s, d in seed:
        after.setdefault(s, []).append(d)
    for s, d in edges:
        seen, stack = set(), [d]
        while stack:
            k = stack.pop()
            if k not in seen:
                seen.add(k)
                stack += after.get(k, [])
        out[s, d] = s not in seen
        if out[s, d]:
            after.setdefault(s, []).append(d)
    return out


def reach(edges):
    after, out = {}, {}
    for s, d in edges:
        after.setdefault(s, set()).add(d)
    for n in after:
        seen, stack = set(), list(after[n])
        while stack:
            k = stack.pop()
            if k not in seen:
                seen.add(k)
                stack += after.get(k, ())
        out[n] = seen
    return out


def random_graphs(seed, graphs=12):
    rnd, edges = random.Random(seed), []
    for g in range(graphs):
        n = rnd.randrange(2, 14)
        edges += {(f"{g}.{rnd.randrange(n)}", f"{g}.{rnd.randrange(n)}") for _ in range(rnd.randrange(1, 3 * n))}
    rnd.shuffle(edges)
    return edges


def test_strong_components_equal_mutual_reach(spark):
    edges = random_graphs(3)
    r = reach(edges)
    want = {}
    for a in r:
        both = {b for b in r[a] if a in r.get(b, ())} | {a}
        if len(both) > 1:
            want[a] = frozenset(both)
    got = {}
    for row in Y.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect():
        got.setdefault(row.scc, set()).add(row.id)
    assert {n: frozenset(c) for c in got.values() for n in c} == want and want
    assert Y.strong_components(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a")], "src string, dst string")).count() == 0


@pytest.mark.parametrize("kind", ["none", "acyclic", "cyclic"])
def test_acyclic_filter_equals_the_sequential_rule(spark, kind):
    edges = random_graphs(5)
    seed = []
    if kind != "none":
        seed = [e for e, fine in sequential(random_graphs(8)).items() if fine or kind == "cyclic"]
    rows = [(s, d, k, "x") for k, (s, d) in enumerate(edges)]
    df = spark.createDataFrame(rows, "src string, dst string, at int, part string").repartition(3)
    out = Y.accept_acyclic(df, ["at"], spark.createDataFrame(seed, "src string, dst string") if seed else None)
    assert out.columns == ["src", "dst", "at", "part", "accepted"]
    assert {(r.src, r.dst): r.accepted for r in out.collect()} == sequential(edges, seed)


def test_places_follow_a_long_run_of_edges():
    rnd = random.Random(4)
    edges = list({(rnd.randrange(60), rnd.randrange(60)) for _ in range(900)})
    rnd.shuffle(edges)
    order, got = Y.TopologicalOrder(), {}
    for s, d in edges:
        got[s, d] = not order.closes(s, d)
        if got[s, d]:
            order.add(s, d)
            assert order.place[s] < order.place[d]
    assert got == sequential(edges)


def test_acyclic_edges_of_the_tables(spark):
    from loomgraph.catalog import QUERIES
    from loomgraph.plans.structure import supply

    small = "/root/testdata/sf0.001"
    rows = sorted(supply(spark, small).collect(), key=lambda r: (-r.n, r.src, r.dst))
    want = sequential([(r.src, r.dst) for r in rows])
    assert {(r.src, r.dst): r.accepted for r in QUERIES["acyclic_edges"](spark, small).collect()} == want
    assert any(not fine for fine in want.values())


def test_a_large_graph_without_cycles_needs_no_groups(spark):
    i = F.col("id")
    e = spark.range(2_000_000).select((F.xxhash64(i) % 50_000).alias("a"), (F.xxhash64(i, F.lit(1)) % 50_000).alias("b"), i.alias("w")).where("abs(a) % 4 < abs(b) % 4")
    out = Y.accept_acyclic(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), ["w"])
    assert "InPandas" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.groupBy("accepted").count().collect()] == [(True, e.count())]


def test_chains_and_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("b", "c"), ("c", "d"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("l", "l")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {("".join(r.path), r.length, r.closes) for r in Y.prerequisite_chains(df, 3).collect()}
    assert got == {
        ("ab", 1, False), ("bc", 1, False), ("cd", 1, False), ("ac", 1, False), ("abc", 2, False), ("bcd", 2, False), ("acd", 2, False), ("abcd", 3, False),
        ("xy", 1, False), ("yx", 1, False), ("yz", 1, False), ("xyx", 2, True), ("yxy", 2, True), ("xyz", 2, False), ("ll", 1, True),
    }
    assert {"".join(r.path) for r in Y.prerequisite_chains(df, 2, spark.createDataFrame([("b",)], "src string")).collect()} == {"bc", "bcd"}
    lengths = Y.chain_lengths(df)
    assert {r.id: r.length for r in lengths.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None, "l": None}
    assert tuple(Y.chain_summary(lengths).first()) == (8, 3, 3, 1.5, 4)
    assert Y.chain_lengths(df.where("false")).count() == 0 and Y.prerequisite_chains(df.where("false"), 4).count() == 0


@pytest.mark.parametrize("heavy", [2000, 3])
@pytest.mark.parametrize("apart", [False, True])
def test_overlap_equals_all_pairs(spark, monkeypatch, heavy, apart):
    monkeypatch.setattr(O, "HEAVY", heavy)
    rnd = random.Random(9)
    sets = [(f"s{k:03}", f"g{k % 3}", [f"t{t}" for t in {int(rnd.paretovariate(0.7)) for _ in range(rnd.randrange(0, 9))} if t < 60] + ["everywhere"]) for k in range(90)]
    df = spark.createDataFrame([*sets, ("none", "g0", [])], "id string, grp string, tokens array<string>")
    for least in (1, 2, 4):
        want = {(a[0], b[0]): sorted({*a[2]} & {*b[2]}) for a in sets for b in sets if a[0] < b[0] and (not apart or a[1] != b[1])}
        got = {(r.a, r.b): r.shared for r in O.overlap_pairs(df, least, apart).collect()}
        assert got == {p: s for p, s in want.items() if len(s) >= least}
        if not apart:
            members = df.select("id", F.explode("tokens").alias("token"))
            counts = O.overlap_counts(members.unionByName(members), least)
            assert {(r.a, r.b): r.shared for r in counts.collect()} == {p: len(s) for p, s in want.items() if len(s) >= least}
            assert "array_intersect" not in counts._jdf.queryExecution().toString()  # pairs carry no sets


def test_a_token_of_every_set_makes_no_pairs_and_no_hot_task(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("grp"), F.array(F.lit("all"), F.concat(F.lit("p"), F.floor(F.col("id") / 2))).alias("tokens"))
    pairs, _ = O.candidate_pairs(df, 2)
    assert pairs.count() == 10_000
    # one token that a tenth of the sets holds, where a single common token is enough: dealt to chunks of at most about HEAVY sets
    one = df.withColumn("tokens", F.when(F.col("id") % 10 == 0, F.array(F.lit("hot"))).otherwise(F.array(F.concat(F.lit("p"), "id"))))
    _, heads = O.prefixes(one, 1)
    sizes = {(r.token, r.chunk): r["count"] for r in heads.groupBy("token", "chunk").count().where("token = 'hot'").collect()}
    assert sum(sizes.values()) == 2000 and max(sizes.values()) <= 2000


@pytest.mark.parametrize("heavy", [2000, 2])
def test_containment_equals_all_pairs(spark, monkeypatch, heavy):
    monkeypatch.setattr(O, "HEAVY", heavy)
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abé %_") for _ in range(n))
    patterns = {word(rnd.randrange(1, 6)) for _ in range(120)} | {"", "zzz"}
    texts = {word(rnd.randrange(0, 15)) for _ in range(80)} | {"", "a" * 3000}
    got = O.contained(spark.createDataFrame([(p,) for p in patterns] + [(None,)], "pattern string"), spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))
    assert sorted(map(tuple, got.collect())) == sorted((p, t) for p in patterns for t in texts if p and p in t)


def test_values_at_places(spark):
    rnd = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rnd.normal(size=501)] + [("b", float(v)) for v in rnd.integers(0, 3, 400)] + [(None, 7.0), ("c", None), ("c", float("nan")), ("d", -1e308), ("d", 1e308), ("d", 5e-324)]
    rows += [("e", float(10.0**k)) for k in range(-300, 300, 3)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    n = F.col("n")
    got = {r.k: r for r in values_at(df, "v", ["k"], {"first": F.lit(0), "upper": F.floor(n / 2), "last": n - 1, "third": F.floor(n / 3)}).collect()}
    assert set(got) == {"a", "b", None, "d", "e"}
    for k, r in got.items():
        v = sorted(x for key, x in rows if key == k)
        assert (r.n, r.first, r.upper, r.last, r.third, r.low, r.high) == (len(v), v[0], v[len(v) // 2], v[-1], v[len(v) // 3], v[0], v[-1])
    whole = values_at(df.where("k = 'a'"), "v", [], {"m": F.floor(n / 2)}).first()
    assert whole.m == sorted(x for k, x in rows if k == "a")[250]
    ids = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") * 3_000_000_000_000).alias("v"))
    assert {r.k: r.m for r in values_at(ids, "v", ["k"], {"m": F.floor(n / 2)}).collect()} == {k: sorted(i * 3_000_000_000_000 for i in range(1000) if i % 7 == k)[len(range(k, 1000, 7)) // 2] for k in range(7)}
    stats = {r.k: (r.n, r.median, r.low) for r in M.summary_by(df, "v", "k").collect()}
    assert stats["b"][1] == float(np.median([v for k, v in rows if k == "b"])) and stats["c"] == (1, None, None) and stats[None] == (1, 7.0, 7.0)
    plan = values_at(df, "v", ["k"], {"m": F.floor(n / 2)})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect" not in plan


def cluster_vectors(spark, n=3000, d=12, clusters=30):
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(clusters, d)) * 4
    x = centres[rnd.integers(0, clusters, n)] + 0.15 * rnd.normal(size=(n, d))
    return x, spark.createDataFrame([(f"{k:05}", v.tolist(), f"g{k % 4}") for k, v in enumerate(x)], "id string, v array<double>, grade string")


def best(x, k, other=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((1 + np.clip(u @ u.T, -1, 1)) / 2, 6)
    np.fill_diagonal(s, -1)
    if other is not None:
        s[other] = -1
    return {(f"{i:05}", r + 1): (f"{j:05}", s[i, j]) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:k])}


def test_index_prunes_and_stays_exact(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(V, "BLOCK", 64)
    x, df = cluster_vectors(spark)
    index = V.create(df, str(tmp_path), "m", "grade")
    got = {(r.source, r["rank"]): (r.target, r.score) for r in S.neighbours(None, index, 5).collect()}
    assert got == best(x, 5)
    other = np.equal.outer(np.arange(len(x)) % 4, np.arange(len(x)) % 4)
    assert {(r.source, r["rank"]): (r.target, r.score) for r in S.neighbours(None, index, 3, group="grade").collect()} == best(x, 3, other)
    some = df.where("id < '00040'")
    assert {(r.source, r["rank"]): (r.target, r.score) for r in S.neighbours(some, index, 5).collect()} == {k: v for k, v in got.items() if k[0] < "00040"}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((1 + np.clip(u @ u.T, -1, 1)) / 2, 6)
    np.fill_diagonal(s, -1)
    asked = [(f"{i:05}", f"{j:05}", float(s[i, j])) for i, j in ((0, 1), (0, 2), (7, 2999), (2999, 7))]
    ranks = S.ranks_of(spark.createDataFrame(asked, "source string, target string, score double"), None, index).collect()
    assert {(r.source, r.target): r["rank"] for r in ranks} == {(a, b): 1 + int((s[int(a)] > v).sum()) for a, b, v in asked}
    assert S.visited_share(index, 5) < 0.25


@pytest.mark.parametrize("heavy", [2000, 3])
def test_shared_targets_of_all_pairs_of_a_group(spark, monkeypatch, heavy):
    monkeypatch.setattr(O, "HEAVY", heavy)
    rnd = random.Random(5)
    nodes = [(k, None if k == 7 else k % 3, "x" if k % 2 else "y") for k in range(40)]
    edges = [(rnd.randrange(40), f"t{rnd.randrange(6)}") for _ in range(150)]
    of = {k: {d for s, d in edges if s == k} for k in range(40)}
    want = {(a[0], b[0]): sorted(of[a[0]] & of[b[0]]) for a in nodes for b in nodes if a[0] < b[0] and a[1:] == b[1:] and a[1] is not None}
    got = X.shared_in_groups(spark.createDataFrame(nodes, "id long, k int, m string"), spark.createDataFrame(edges, "src long, dst string"), ["k", "m"]).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want
    assert "x.c_nationkey = y.c_nationkey" in ORACLES["shared_neighbors"]  # all pairs of a nation and segment


def test_edges_of_one_source_need_one_search(monkeypatch):
    searches = []
    between = Y.TopologicalOrder._between
    monkeypatch.setattr(Y.TopologicalOrder, "_between", lambda self, *a: searches.append(a) or between(self, *a))
    rnd = np.random.default_rng(4)
    for k in range(20):
        edges = sorted({(int(s), int(d)) for s, d in rnd.integers(0, 15, (80, 2))}, key=lambda e: (e[0] * 7 % 5, e[0], e[1]))
        runs, single, kept, wanted = Y.TopologicalOrder(), Y.TopologicalOrder(), [], []
        searches.clear()
        for s in dict.fromkeys(e[0] for e in edges):
            ends = [d for x, d in edges if x == s]
            bad = runs.closing(s, ends)
            for d in ends:
                kept.append(d not in bad)
                if kept[-1]:
                    runs.add(s, d)
        assert len(searches) <= 2 * len({e[0] for e in edges})  # whatever the number of edges
        for s, d in edges:
            wanted.append(not single.closes(s, d))
            if wanted[-1]:
                single.add(s, d)
        assert kept == wanted, k


def test_blocks_of_data_are_sent_once_for_a_group_of_queries(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "GROUPS", 2)
    x = np.random.default_rng(3).normal(size=(1000, 24))  # random directions: no pair of blocks is ruled out
    df = spark.createDataFrame([(f"{i:05}", [float(c) for c in v]) for i, v in enumerate(x)], "id string, v array<double>")
    index = V.create(df, str(tmp_path), "m")
    blocks = index.blocks.count()
    rows, tasks = V.dealt(index.blocks, index, lambda b, _: np.full(len(b.ids), -np.inf), False, None)
    sent = rows.where("at > double('-infinity')").count()
    assert blocks > 50 and sent == 2 * blocks  # not blocks ** 2
    assert rows.where("task < 0").count() == 0 and rows.agg({"task": "max"}).first()[0] < tasks
    assert {(r.source, r["rank"]): (r.target, r.score) for r in S.neighbours(None, index, 5).collect()} == best(x, 5)


def test_index_life_cycle(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(V, "BLOCK", 8)
    _, df = cluster_vectors(spark, 60, 4, 3)
    path = str(tmp_path)
    assert V.load(spark, path, "m") is None and V.describe(spark, path).count() == 0
    first = V.ensure(df, path, "m", 4)
    assert V.ensure(df, path, "m", 4).path == first.path and first.blocks.agg(F.sum("n")).first()[0] == 60
    assert V.create(df.limit(10), path, "m").version == 2 and V.load(spark, path, "m").n == 10
    V.create(df, path, "other", "grade")
    assert sorted((r.model, r.dimension, r.version, r.n, r.grouped) for r in V.describe(spark, path).collect()) == [("m", 4, 1, 60, False), ("m", 4, 2, 10, False), ("other", 4, 1, 60, True)]
    V.ensure(df.select("id", F.slice("v", 1, 3).alias("v")), path, "m", 3)
    assert sorted((r.model, r.dimension, r.version) for r in V.describe(spark, path).collect()) == [("m", 3, 1), ("other", 4, 1)]
    V.drop(spark, path, "m")
    assert [r.model for r in V.describe(spark, path).collect()] == ["other"]
    with pytest.raises(ValueError):
        V.create(df.unionByName(df.select("id", F.slice("v", 1, 3).alias("v"), "grade")), path, "mixed")
    with pytest.raises(ValueError):
        S.neighbours(None, V.load(spark, path, "m") or V.create(df, path, "m"), 2, group="grade")
    empty = V.create(df.where("false"), path, "none")
    assert empty.n == 0 and S.neighbours(None, empty, 3).count() == 0


def replayed(edges):
    """The rounds once more, one move after the other; the modularity grows with each."""
    adjacent = {}
    for a, b in {tuple(sorted(e)) for e in edges if e[0] != e[1]}:
        adjacent.setdefault(a, {})[b] = adjacent.setdefault(b, {})[a] = 1
    m2 = sum(map(len, adjacent.values()))
    part = {n: n for n in {x for e in edges for x in e}}
    def quality(adj, place):
        tot, inside = {}, 0
        for x, ys in adj.items():
            tot[place[x]] = tot.get(place[x], 0) + sum(ys.values())
            inside += sum(w for y, w in ys.items() if place[y] == place[x])
        return inside * m2 - sum(t * t for t in tot.values())

    while m2:
        place, k, moved = {x: x for x in adjacent}, {x: sum(ys.values()) for x, ys in adjacent.items()}, False
        while True:
            tot, found = {}, []
            for x, c in place.items():
                tot[c] = tot.get(c, 0) + k[x]
            for x, ys in adjacent.items():
                links = {}
                for y, w in ys.items():
                    if y != x:
                        links[place[y]] = links.get(place[y], 0) + w
                for c, w in links.items():
                    gain = m2 * (w - links.get(place[x], 0)) - k[x] * (tot[c] - tot[place[x]] + k[x])
                    if c != place[x] and gain > 0:
                        found.append((gain, x, place[x], c))
            if not found:
                break
            moved, made, tops, best = True, [], {}, {}
            for gain, x, own, c in found:
                for name, out in ((own, True), (c, False)):
                    tops[name] = min(tops.get(name, (0,)), (-gain, x, c, out))
            for gain, x, own, c in found:
                if tops[own][3] and not tops[c][3]:
                    best[x] = min(best.get(x, (0,)), (-gain, c, x, own))
            ranked, into, out = sorted((g, x, own, c) for g, c, x, own in best.values()), {}, {}
            for loss, x, own, c in ranked:
                if -loss > k[x] * (into.get(c, 0) + out.get(own, 0)):
                    made.append((x, c))
                into[c], out[own] = into.get(c, 0) + k[x], out.get(own, 0) + k[x]
            before = quality(adjacent, place)
            for x, c in made:
                place[x] = c
            assert quality(adjacent, place) > before
        if not moved:
            break
        part = {n: place.get(c, c) for n, c in part.items()}
        coarse = {}
        for x, ys in adjacent.items():
            for y, w in ys.items():
                row = coarse.setdefault(place[x], {})
                row[place[y]] = row.get(place[y], 0) + w
        adjacent = coarse
    least = {}
    for n, c in part.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in part.items()}


def test_louvain_equals_a_replay_of_its_rounds(spark):
    from loomgraph.operators import louvain as L
    from loomgraph.operators import paths as P

    rnd = random.Random(12)
    edges = [(f"{g}{rnd.randrange(9)}", f"{g}{rnd.randrange(9)}") for g in "abcd" for _ in range(26)] + [(f"{a}1", f"{b}2") for a, b in ("ab", "bc", "cd", "da")]
    edges += [("hub", f"leaf{k}") for k in range(12)] + [("x", "x")]
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in {x for e in edges for x in e}], "id string")
    got = {r.id: r.part for r in L.louvain(nodes, df).collect()}
    assert got == replayed(edges)
    q = L.louvain_modularity(nodes, df).first()
    assert q.communities == len(set(got.values())) and q.q >= P.best_partition(nodes, df).first().q - 1e-12
    assert {r.id: r.part for r in L.louvain(nodes, df.where("false")).collect()} == {r.id: r.id for r in nodes.collect()}


def ring_of_cliques(cliques, size):
    """Cliques in a ring, with links between others at random."""
    rnd = random.Random(7)
    edges = [(f"n{g}-{a}", f"n{g}-{b}") for g in range(cliques) for a in range(size) for b in range(a)]
    return edges + [(f"n{g}-0", f"n{(g + 1) % cliques}-1") for g in range(cliques)] + [(f"n{rnd.randrange(cliques)}-{rnd.randrange(size)}", f"n{rnd.randrange(cliques)}-{rnd.randrange(size)}") for _ in range(3 * cliques)]


@pytest.mark.parametrize("few", [100_000, 60])
def test_louvain_rounds_are_one_job_each_and_agree_with_few_and_many_moves(spark, monkeypatch, few):
    from loomgraph.operators import louvain as L

    monkeypatch.setattr(L, "LEAST_ROWS", 100, raising=False)  # several tasks
    monkeypatch.setattr(L, "FEW", few, raising=False)
    edges = ring_of_cliques(40, 4)
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in {x for e in edges for x in e}], "id string")
    spark.sparkContext.setJobGroup(f"louvain-{few}", "rounds")
    try:
        got = {r.id: r.part for r in L.louvain(nodes, df).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"louvain-{few}"))
    finally:
        spark.sparkContext.setJobGroup("tests", "")
    assert got == replayed(edges)
    assert jobs < 120  # nine rounds


def test_louvain_gains_beyond_machine_integers_are_exact():
    import numpy as np
    from loomgraph.operators import louvain as L

    x, y, w = np.array([0, 0, 1, 1, 2, 2]), np.array([1, 2, 0, 2, 0, 1]), np.array([2**40, 2**40 + 1, 2**40, 1, 2**40 + 1, 1])
    k = {0: 2**41 + 1, 1: 2**40 + 1, 2: 2**40 + 2}
    m2 = sum(k.values())
    moves = L.Part.of(m2, 0, x, y, w, np.array([k[v] for v in y.tolist()])).moves
    assert {(m["x"], m["c"], m["gain"]) for m in moves} == {(a, b, n * m2 - k[a] * k[b]) for a, b, n in zip(x.tolist(), y.tolist(), w.tolist()) if n * m2 > k[a] * k[b]}
    sides = L._charged(L._sides(L._suited(moves, L._best(L._sides(moves)))))
    assert len(sides) and set(L._accepted(sides)["x"].tolist()) <= {0, 1, 2}


def test_reachable_pairs_leave_sources_out_of_the_rounds(spark, monkeypatch):
    from loomgraph.operators import paths as P

    rnd = random.Random(5)
    edges = [(f"s{k}", f"m{rnd.randrange(6)}") for k in range(40)] + [("m0", "m1"), ("m1", "m2"), ("m2", "m0"), ("m3", "t"), ("m3", "m3"), ("s1", "t"), ("u", "v"), ("s2", "s2")]
    ends = {}
    for a, b in edges:
        ends.setdefault(a, set()).add(b)
    want = set()
    for a in ends:
        todo, seen = list(ends[a]), set()
        while todo:
            if (b := todo.pop()) not in seen:
                seen.add(b)
                todo += ends.get(b, ())
        want |= {(a, b) for b in seen}
    first, closure = [], P._closure
    monkeypatch.setattr(P, "_closure", lambda f, e: first.append({r.src for r in f.collect()}) or closure(f, e))
    got = [tuple(r) for r in P.reachable(spark.createDataFrame(edges, "src string, dst string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert first == [{"m0", "m1", "m2", "m3", "s2"}]


def exchanges(df):
    """Shuffles by keys of a plan that has not run."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_added_and_removed_rows_meet_once_in_tasks_of_bounded_size(spark):
    from loomgraph.operators import compare as K
    from loomgraph.operators import tables as T

    old = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", None), ("d", 4), ("d", 4)], "k string, v int")
    got = K.added_removed(old, new, ["k", "v"])
    assert sorted(map(tuple, got.collect())) == [("c", 3, "removed"), ("d", 4, "added")]  # nulls alike, as EXCEPT has it
    assert exchanges(got) == 1
    few = T.spread(spark.range(100).withColumn("k", F.col("id") % 50), "k", rows=5)
    assert few.rdd.getNumPartitions() == 21 and T.spread(spark.range(100), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_symmetric_edges_and_edges_of_a_context_are_shuffled_once(spark, sf_dir):
    from loomgraph.plans.changes import context_top_edges

    e = spark.createDataFrame([("a", "b", "T"), ("b", "a", "T"), ("b", "a", "T"), ("a", "c", "T"), ("c", "a", "U"), ("d", "d", "T"), ("e", "f", "T"), ("e", "f", "T")], "src string, dst string, rel_type string")
    got = M.symmetric(e)
    assert [tuple(r) for r in got.collect()] == [("a", "b", "T")] and exchanges(got) == 1
    assert exchanges(context_top_edges(spark, sf_dir)) == 1


@pytest.mark.parametrize(("patience", "sources"), [(-1, 1), (-1, 3), (-1, 100), (0, 2), (4, 2048)])
def test_blocks_of_sources_decide_like_the_sequential_rule(monkeypatch, patience, sources):
    monkeypatch.setattr(Y, "PATIENCE", patience)
    monkeypatch.setattr(Y, "SOURCES", sources)
    for seed in range(20):
        rnd = random.Random(seed)
        edges = list({(rnd.randrange(25), rnd.randrange(25)) for _ in range(150)})
        if seed % 2:
            edges.sort(key=lambda e: (e[0] * 7 % 5, e))
        else:
            rnd.shuffle(edges)
        keep = Y.TopologicalOrder().accept([(s, [d for _, d in run]) for s, run in itertools.groupby(edges, key=lambda e: e[0])])
        assert dict(zip(edges, keep, strict=True)) == sequential(edges)


def test_searches_of_a_large_component_stay_short():
    # a ring of layers, as parts to suppliers to customers to parts: searches alone walk most of it again and again
    rnd = random.Random(3)
    layer = lambda k, n: [(k * 10_000 + a, (k + 1) % 3 * 10_000 + b) for a, b in sorted({(rnd.randrange(2000), rnd.randrange(2000)) for _ in range(n)})]
    edges = layer(0, 6000) + layer(1, 6000) + layer(2, 6000)
    runs = [(s, [d for _, d in run]) for s, run in itertools.groupby(edges, key=lambda e: e[0])]
    at = Y.TopologicalOrder()
    keep = at.accept(runs)
    assert at.steps < 8 * len(edges)
    assert not all(keep)
    ways = {}
    for (s, d), fine in zip(edges, keep, strict=True):
        if fine:
            ways.setdefault(s, []).append(d)
    list(graphlib.TopologicalSorter(ways).static_order())  # an error if what is accepted has a cycle


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    # two groups of 12 copies: the ten best of each row are in its group, the pairs between the groups reach the threshold too
    a, b = np.array([1.0, 0, 0]), np.array([0.4, 0.6, 0.7])
    rows = [(f"{g}{k:02}", (v + 0.001 * k * np.array([0, 0, 1.0])).tolist()) for g, v in (("a", a), ("b", b)) for k in range(12)] + [("z", [-1.0, 0.0, 0.0])]
    v = S.index_of(spark.createDataFrame(rows, "id string, v array<double>"))
    got = {r.id: r.component for r in P.connected_components(v.ids, S.links(v, 0.68).toDF("src", "dst")).collect()}
    assert got == {i: "z" if i == "z" else "a00" for i, _ in rows}
    top = S.neighbours(None, v, 10).where("score >= 0.68")
    assert top.where("left(source, 1) <> left(target, 1)").isEmpty()
    assert "rank" not in ORACLES["connected_components"]

    # many blocks: components as by brute force, fewer pairs than rows in each task
    monkeypatch.setattr(V, "BLOCK", 64)
    rnd = np.random.default_rng(6)
    u = rnd.normal(size=(1500, 8))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = S.index_of(spark.createDataFrame([(f"{k:04}", r.tolist()) for k, r in enumerate(u)], "id string, v array<double>"))
    for least in (0.9, 0.95):
        close = np.round((1 + np.clip(u @ u.T, -1, 1)) / 2, 6) >= least
        want = np.arange(1500)
        while True:
            less = np.where(close, want[None], 1500).min(axis=1)
            if (less == want).all():
                break
            want = less
        found = S.links(v, least).cache()
        assert {r.id: r.component for r in P.connected_components(v.ids, found.toDF("src", "dst")).collect()} == {f"{k:04}": f"{c:04}" for k, c in enumerate(want)}
        assert 1 < len(set(want.tolist())) < 1500
        assert all(close[int(r.source), int(r.target)] for r in found.collect())


def test_far_rows_of_a_block_are_not_compared(monkeypatch):
    # blocks of 8 tight groups each: a query meets the group that it is near to, results are those of all pairs
    rnd = np.random.default_rng(9)
    middles = rnd.normal(size=(16, 12))

    def block(first, name):
        x = np.concatenate([m + 0.02 * rnd.normal(size=(V.CAP, 12)) for m in middles[first : first + 8]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return V.Block(np.array([f"{name}{k:04}" for k in range(len(x))], object), np.full(len(x), None, object), x, x.astype(np.float32))

    q, near, far = block(0, "q"), block(4, "n"), block(8, "f")
    compared, plain = [], V._above
    monkeypatch.setattr(V, "_above", lambda a, b, *more: compared.append(len(a.ids) * len(b.ids)) or plain(a, b, *more))
    least = np.full(len(q.ids), 0.99)
    for r in (near, far):
        got = sorted((int(i), int(j), float(s)) for i, j, s in zip(*V.above(q, r, least, False, False, False), strict=True) if s >= 0.99)
        every = V.scores(q, r, False, False, False)
        assert got == [(int(i), int(j), float(every[i, j])) for i, j in zip(*np.nonzero(every >= 0.99), strict=True)]
        assert bool(got) == (r is near)
    assert sum(compared) <= len(q.ids) * len(near.ids) // 4
    n = V.Nearest(q, 3, False, False, False, False)
    for r in (near, far, near):  # every row twice: ties are decided by id
        n.add(r)
    rows = [r for batch in n.rows() for r in batch.to_pylist()]
    every = np.concatenate([V.scores(q, r, False, False, False) for r in (near, far, near)], axis=1)
    ids = [*near.ids, *far.ids, *near.ids]
    for k in (0, 500, 1023):
        best = sorted((-s, t) for s, t in zip(every[k].tolist(), ids, strict=True))[:3]
        assert sorted((-r["score"], r["target"]) for r in rows if r["source"] == q.ids[k]) == best


def test_rows_of_a_group_go_to_each_pair_of_chunks_once(spark, monkeypatch):
    monkeypatch.setattr(O, "TOGETHER", 5)
    rows = spark.range(50).select("id", F.lit(1).alias("k"), (F.col("id") * 7 % 11).alias("x")).unionByName(spark.createDataFrame([(90, None, 1), (91, 2, 1), (92, 2, 3)], "id long, k int, x long"))
    frame, sent = type(rows), []
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: sent.append(self.count()) or plain(self, *a))
    got = {(r.a, r.b): (r.x_a, r.x_b) for r in O.pairs_of_groups(rows, ["k"]).collect()}
    assert got == {(a, b): (a * 7 % 11, b * 7 % 11) for a in range(50) for b in range(a + 1, 50)} | {(91, 92): (1, 3)}
    assert sent == [5 * sum(range(1, 11)) + 2] * 2  # ten chunks; each against each would be 502
