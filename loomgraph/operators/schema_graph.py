"""A graph under an ontology: what retrieval, classification and storage ask of it, as DataFrames.

The ontology is data (``schemas.SchemaSpec``); a graph with other habits overrides a method. Nothing is changed in place: writes return the graph with its new tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embed_text
from ..schemas import SchemaSpec
from ..sources import files
from . import candidates, context, similarity, upsert, vector_index


@dataclass(frozen=True)
class GraphSchema:
    """nodes, edges and stored vectors (node_id, model, vector) of an ontology, and the folder of its vector indexes."""

    spec: SchemaSpec
    nodes: DataFrame
    edges: DataFrame
    stored: DataFrame
    index_path: str

    @property
    def concepts(self) -> DataFrame:
        return self.nodes.where(F.col("label") == self.spec.concept_label)

    def embed_texts(self) -> DataFrame:
        """id, text that is embedded."""
        extras = [(name, F.col(c)) for name, c in self.spec.embed_fields]
        return self.concepts.select("id", embed_text(F.col("name"), F.col("description"), extras, self.spec.name if self.spec.name in ("a", "b") else "a").alias("text"))

    def vectors(self, model: str) -> DataFrame:
        """id, v, grade of the concepts that have a vector of this model."""
        rows = self.stored.where(F.col("model") == model).join(self.concepts.select(F.col("id").alias("node_id"), "grade"), "node_id")
        return similarity.vectors(rows, "node_id", "vector").join(rows.select(F.col("node_id").cast("string").alias("id"), "grade"), "id")

    def create_vector_index(self, model: str, dimension: int) -> vector_index.VectorIndex:
        """The index of a model; one of another dimension is dropped, vectors of another length are an error."""
        upsert.require_dimension(self.stored, model, dimension)
        return vector_index.ensure(self.vectors(model), self.index_path, model, dimension, "grade")

    def drop_vector_indexes(self, model: str) -> None:
        vector_index.drop(self.stored.sparkSession, self.index_path, model)

    def index_info(self) -> DataFrame:
        return vector_index.describe(self.stored.sparkSession, self.index_path)

    def embedding_counts(self) -> DataFrame:
        """model, n, dimension, consistent."""
        return upsert.index_meta(self.stored)

    def with_embeddings(self, rows: DataFrame) -> GraphSchema:
        """With the vectors (node_id, model, vector) stored; a vector of the same node and model is replaced."""
        return replace(self, stored=upsert.upsert(self.stored, rows, ["node_id", "model"]))

    def without_current_embedding(self, model: str) -> DataFrame:
        return candidates.stale(self.concepts, self.stored, model)

    def similar_nodes(self, model: str, k: int, threshold: float, queries: DataFrame | None = None, other_grade: bool = False) -> DataFrame:
        """source, target, score, rank over the model's index, of given (id, v[, grade]) rows or of all concepts."""
        index = vector_index.load(self.stored.sparkSession, self.index_path, model)
        if index is None:
            raise ValueError(f"no vector index of {model}")
        return similarity.neighbours(queries, index, k, group="grade" if other_grade else None).where(F.col("score") >= threshold)

    def completion_nodes(self, document: str | None = None, cross: bool = False) -> DataFrame:
        return files.concepts_for_completion(self.nodes, self.edges, document, cross)

    def classification_fields(self, names: DataFrame) -> DataFrame:
        return files.fields_of(self.nodes, names)

    def context(self, pairs: DataFrame, chapters: DataFrame, k: int = 5) -> DataFrame:
        return context.with_context(pairs, self.nodes, chapters, self.edges, k)

    def documents(self) -> DataFrame:
        return files.documents_with_counts(self.nodes)

    def concept_count(self) -> DataFrame:
        return self.concepts.agg(F.count(F.lit(1)).alias("n"))

    def similar_pairs(self) -> DataFrame:
        return files.similar_edges(self.edges)

    def pairs_to_classify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that no typed edge joins yet."""
        return candidates.without_existing(pairs, self.edges)

    def with_similar(self, pairs: DataFrame) -> GraphSchema:
        """With SIMILAR_TO edges of (a, b, score), ends in order."""
        return replace(self, edges=upsert.upsert_similar(self.edges, pairs))

    def with_typed(self, rows: DataFrame) -> GraphSchema:
        """With classified edges (src, dst, rel_type, confidence) under the ontology's prefix; a class it does not know is an error, 'none' is left out."""
        allowed = tuple(c for c in self.spec.classes if c != "none")
        rows = upsert.guard_vocabulary(rows.where(upsert.not_none()), allowed)
        stored = rows.withColumn("rel_type", F.concat(F.lit(self.spec.typed_prefix), "rel_type"))
        return replace(self, edges=upsert.upsert(self.edges, stored.select("src", "dst", "rel_type", "confidence"), ["src", "dst", "rel_type"], ["confidence"]))
