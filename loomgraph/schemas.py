"""Explicit schemas and vocabularies. Production readers never infer a schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

REVIEW = "status STRING, consensus STRING, n_reviewers BIGINT, ratings MAP<STRING,STRING>, comments MAP<STRING,STRING>"
RELATION = (
    "type STRING, target STRING, description STRING, provenance STRING, confidence DOUBLE, evidence_quote STRING, "
    f"expert_validation_added BOOLEAN, completion_added BOOLEAN, expert_review STRUCT<{REVIEW}>"
)
CROSS_LINK = (
    "target_book STRING, target_concept STRING, relation_type STRING, direction STRING, explanation STRING, evidence_quote STRING, confidence DOUBLE, completion_added BOOLEAN"
)
CONCEPT = (
    "name STRING, description STRING, glossary_validated BOOLEAN, materi_pokok_ref STRING, provenance STRING, "
    f"relations ARRAY<STRUCT<{RELATION}>>, cross_book_links ARRAY<STRUCT<{CROSS_LINK}>>"
)
SUBTOPIC = f"name STRING, provenance STRING, concepts ARRAY<STRUCT<{CONCEPT}>>"
CHAPTER = (
    "chapter STRING, chapter_summary STRING, previous STRING, next STRING, subchapters ARRAY<STRING>, "
    f"subtopics ARRAY<STRUCT<{SUBTOPIC}>>, chapter_relations ARRAY<STRUCT<type STRING, target_chapter STRING, description STRING, explanation STRING, "
    "concept_links ARRAY<STRUCT<source_concept STRING, target_concept STRING, explanation STRING>>>>"
)
BOOK = f"grade STRING, chapters ARRAY<STRUCT<{CHAPTER}>>"
STAGED_EDGE = (
    "rel_type STRING, source_label STRING, source_name STRING, source_grade STRING, target_label STRING, target_name STRING, target_grade STRING, "
    "properties STRUCT<description STRING, relation_type STRING, confidence DOUBLE, method STRING>"
)
EDGE_DUMP = (
    "version STRING, source_state STRING, date_captured STRING, captured_from STRING, method STRING, "
    "params STRUCT<embed_model STRING, chat_model STRING, threshold DOUBLE, top_k BIGINT, scope STRING, selected_doc STRING, batch_size BIGINT>, "
    f"edge_count BIGINT, edge_type_breakdown MAP<STRING,BIGINT>, instance_counts_at_capture MAP<STRING,BIGINT>, edges ARRAY<STRUCT<{STAGED_EDGE}>>"
)
REVIEW_FILE = (
    "ratings MAP<STRING,STRING>, comments MAP<STRING,STRING>, "
    "missingTriples ARRAY<STRUCT<chapter STRING, subject STRING, relation STRING, target STRING, description STRING>>, "
    "generalFeedback STRING, completedAt STRING, updatedAt STRING"
)
NODES = (
    "id STRING, label STRING, name STRING, grade STRING, description STRING, materi_pokok_ref STRING, glossary_validated BOOLEAN, provenance STRING, "
    "formula ARRAY<STRING>, variables ARRAY<STRING>, kondisi ARRAY<STRING>"
)
EDGES = (
    "src STRING, dst STRING, rel_type STRING, original_type STRING, description STRING, confidence DOUBLE, score DOUBLE, method STRING, provenance STRING, "
    "expert_status STRING, expert_consensus STRING, expert_n_reviewers BIGINT, expert_review_json STRING"
)
EMBEDDINGS = "node_id STRING, model STRING, vector ARRAY<FLOAT>"
LOW_CONFIDENCE = "konsep_A STRING, mapel_A STRING, relasi STRING, konsep_B STRING, mapel_B STRING, confidence DOUBLE, penjelasan_LLM STRING"
SURVEY_ANSWER = "relationValid STRING, relationTypeCorrect STRING, directionCorrect STRING, comment STRING"

# Relation vocabularies.
WITHIN_BOOK = ("BAGIAN_DARI", "MENYEBABKAN", "BERGANTUNG_PADA", "MENDEFINISIKAN", "MEMPENGARUHI", "BERINTERAKSI_DENGAN", "DIFORMULASIKAN_SEBAGAI")
CROSS_BOOK = ("SAMA_DENGAN", "APLIKASI_DARI", "PRASYARAT_UNTUK", "MEMPERDALAM", "BERKAITAN_DENGAN")
CROSS_BOOK_SYMMETRIC = ("SAMA_DENGAN", "BERKAITAN_DENGAN")
CROSS_BOOK_FLOOR, CROSS_BOOK_FLOORS = 0.7, {"BERKAITAN_DENGAN": 0.85}
HIERARCHICAL = ("BAGIAN_DARI", "PRASYARAT_UNTUK")
STRUCTURAL = ("HAS_CHAPTER", "HAS_SUBTOPIC", "HAS_CONCEPT", "NEXT_CHAPTER")
CHAPTER_LEVEL = ("PRASYARAT", "MEMPERSIAPKAN")
RATINGS = ("correct", "partial", "wrong", "missing")
CLASSES_A = ("isPrerequisiteOf", "supports", "analogousTo", "none")


@dataclass(frozen=True)
class SchemaSpec:
    """An ontology as data: what graphs differ in."""

    name: str
    levels: tuple[str, ...]
    concept_label: str
    key: tuple[str, ...]
    classes: tuple[str, ...]
    symmetric: tuple[str, ...] = ()
    hierarchical: tuple[str, ...] = ()
    typed_prefix: str = ""
    stages_edges: bool = False
    embed_fields: tuple[tuple[str, str], ...] = field(default=())

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, c, c in self.symmetric, c in self.hierarchical) for c in self.classes]
        return spark.createDataFrame(rows, "schema string, rel_type string, symmetric boolean, hierarchical boolean")


SPECS = {
    "a": SchemaSpec(
        "a", ("MataPelajaran", "Document", "Bab", "SubBab", "SubSubBab", "Konsep"), "Konsep", ("name",), CLASSES_A, ("analogousTo",), ("isPrerequisiteOf",),
        embed_fields=(("Rumus", "formula"), ("Variabel", "variables"), ("Kondisi", "kondisi")),
    ),
    "b": SchemaSpec(
        "b", ("Grade", "Chapter", "Subtopic", "Concept"), "Concept", ("name", "grade"), (*CROSS_BOOK, "none"), CROSS_BOOK_SYMMETRIC, ("PRASYARAT_UNTUK",),
        typed_prefix="LINTAS_BUKU_", stages_edges=True, embed_fields=(("Materi Pokok", "materi_pokok_ref"), ("Mata Pelajaran", "grade")),
    ),
}


def spec(name: str) -> SchemaSpec:
    """Registered ontology; unknown names raise."""
    if name not in SPECS:
        raise KeyError(f"unknown schema {name!r}; known: {', '.join(sorted(SPECS))}")
    return SPECS[name]
