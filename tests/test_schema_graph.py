"""A graph under an ontology, from vectors to typed edges."""

import pytest

from loomgraph import schemas
from loomgraph.operators import metrics as M
from loomgraph.operators.schema_graph import GraphSchema


@pytest.fixture
def graph(spark, tmp_path):
    n = [("a", "Concept", "Gaya", "X", "tarikan"), ("b", "Concept", "Medan", "Y", None), ("c", "Concept", "Arus", "Y", ""), ("g", "Grade", "X", None, None)]
    nodes = spark.createDataFrame([(*r, None, None, None, None, None, None) for r in n], schemas.NODES)
    edges = spark.createDataFrame([], schemas.EDGES)
    stored = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("b", "m", [1.0, 0.1]), ("c", "m", [0.0, 1.0]), ("a", "old", [1.0])], schemas.EMBEDDINGS)
    return GraphSchema(schemas.spec("b"), nodes, edges, stored, str(tmp_path))


def test_from_vectors_to_typed_edges(spark, graph):
    assert {r.id: r.text for r in graph.embed_texts().collect()} == {"a": "Gaya. tarikan Mata Pelajaran: X", "b": "Medan. Mata Pelajaran: Y", "c": "Arus. Mata Pelajaran: Y"}
    with pytest.raises(ValueError):
        graph.similar_nodes("m", 1, 0.5)
    graph.create_vector_index("m", 2)
    with pytest.raises(ValueError):
        graph.create_vector_index("m", 3)
    best = {r.source: r.target for r in graph.similar_nodes("m", 1, 0.5).collect()}
    assert best == {"a": "b", "b": "a", "c": "b"}
    assert {(r.source, r.target) for r in graph.similar_nodes("m", 5, 0.9, other_grade=True).collect()} == {("a", "b"), ("b", "a")}
    pairs = spark.createDataFrame([("b", "a", 0.99), ("a", "c", 0.5)], "a string, b string, score double")
    linked = graph.with_similar(pairs).with_typed(spark.createDataFrame([("a", "b", "MEMPERDALAM", 0.9), ("a", "b", "MEMPERDALAM", 0.7), ("a", "c", "none", 0.9)], "src string, dst string, rel_type string, confidence double"))
    assert [(r.src, r.dst, r.score) for r in linked.similar_pairs().collect()] == [("a", "b", 0.99), ("a", "c", 0.5)]
    assert [(r.src, r.dst, r.confidence) for r in linked.edges.where("rel_type = 'LINTAS_BUKU_MEMPERDALAM'").collect()] == [("a", "b", 0.9)]
    assert [(r.a, r.b) for r in linked.pairs_to_classify(pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b")).collect()] == [("a", "c")]
    with pytest.raises(ValueError):
        graph.with_typed(spark.createDataFrame([("a", "b", "supports", 0.9)], "src string, dst string, rel_type string, confidence double"))
    more = graph.with_embeddings(spark.createDataFrame([("a", "m", [0.0, 1.0]), ("b", "new", [1.0])], schemas.EMBEDDINGS))
    assert {(r.model, r.n) for r in more.embedding_counts().collect()} == {("m", 3), ("old", 1), ("new", 1)} and [r.id for r in graph.without_current_embedding("old").orderBy("id").collect()] == ["b", "c"]
    assert graph.concept_count().first().n == 3 and [(r.grade, r.concepts) for r in graph.documents().collect()] == [("X", 1)]
    assert [(r.model, r.n) for r in graph.index_info().collect()] == [("m", 3)]
    graph.drop_vector_indexes("m")
    assert graph.index_info().count() == 0


def test_theory_metrics_of_odd_tables(spark):
    levels = spark.createDataFrame([(x,) for x in (1, 1, 2, 3, 3, 3, None, 9)], "level int")
    assert M.pyramid_compliance(levels, "level", [1, 2, 3]).first().score == pytest.approx(1 - (2 / 6) / 2)
    assert M.pyramid_compliance(levels.where("false"), "level", [1, 2]).first().score is None
    e = spark.createDataFrame([("a", "b", 0.5), ("a", "c", None), ("b", "x", 0.9)], "src string, dst string, confidence double")
    n = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "X"), ("x", "")], "id string, grade string")
    assert tuple(M.cross_domain_ratio(e, n).first()) == (2, 0.5) and M.uncertainty_rate(e, 0.7).first().rate == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        M.composite({"a": (None, 0.5)})
