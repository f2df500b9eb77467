"""Nested books as rows: flattening, node and edge frames, and the loads built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import either, name_key, relation_type, variable
from .candidates import first_wins, last_wins
from .overlap import overlap_counts, overlap_pairs


def subtopics(books: DataFrame) -> DataFrame:
    """grade, chapter_pos, chapter, subtopic_pos, subtopic struct."""
    c = books.select("grade", F.posexplode("chapters").alias("chapter_pos", "c"))
    return c.select("grade", "chapter_pos", F.col("c.chapter").alias("chapter"), F.posexplode("c.subtopics").alias("subtopic_pos", "s"))


def concepts(books: DataFrame) -> DataFrame:
    """One row per concept in reading order; empty arrays give none."""
    s = subtopics(books).select("grade", "chapter_pos", "chapter", "subtopic_pos", F.col("s.name").alias("subtopic"), F.posexplode("s.concepts").alias("concept_pos", "k"))
    return s.select("grade", "chapter_pos", "chapter", "subtopic_pos", "subtopic", "concept_pos", "k.*")


def granularity(books: DataFrame) -> DataFrame:
    """grade, chapters, subtopics, concepts, per_subtopic."""
    s = F.flatten(F.transform("chapters", lambda c: F.coalesce(c["subtopics"], F.array().cast(c_type(books)))))
    n = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.size(x["concepts"]), F.lit(0)))
    return books.select("grade", F.size("chapters").alias("chapters"), F.size(s).alias("subtopics"), n.alias("concepts"), (n / F.nullif(F.size(s), F.lit(0))).alias("per_subtopic"))


def c_type(books: DataFrame) -> str:
    return books.select(F.get("chapters", F.lit(0))["subtopics"].alias("s")).schema["s"].dataType.simpleString()


def triples(books: DataFrame) -> DataFrame:
    """Relations with their depth-first index in the book, from 0."""
    r = concepts(books).select(
        "grade", "chapter_pos", "chapter", "subtopic_pos", "subtopic", "concept_pos", F.col("name").alias("concept"), F.posexplode("relations").alias("relation_pos", "r")
    )
    order = Window.partitionBy("grade").orderBy("chapter_pos", "subtopic_pos", "concept_pos", "relation_pos")
    return r.select("grade", (F.row_number().over(order) - 1).cast("long").alias("index"), "chapter", "subtopic", "concept", F.col("r.type").alias("relation"), F.col("r.target").alias("target"), "r")


def concept_id(name: Column, grade: Column) -> Column:
    """Nodes are keyed by name and grade, so the same name in two books is two nodes."""
    return F.concat_ws("\x1f", grade, name)


def structure(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Grade, Chapter, Subtopic, Concept with HAS_* and NEXT_CHAPTER; a repeated concept keeps its last description."""
    k = concepts(books)
    order = ["chapter_pos", "subtopic_pos", "concept_pos"]
    ids = {
        "Grade": F.col("grade"), "Chapter": F.concat_ws("\x1f", "grade", "chapter"), "Subtopic": F.concat_ws("\x1f", "grade", "chapter", "subtopic"), "Concept": concept_id(F.col("name"), F.col("grade")),
    }
    s = subtopics(books).select("grade", "chapter_pos", "chapter", "subtopic_pos", F.col("s.name").alias("subtopic"))
    c = books.select("grade", F.posexplode("chapters").alias("chapter_pos", "c")).select("grade", "chapter_pos", F.col("c.chapter").alias("chapter"), F.col("c.chapter_summary").alias("summary"))
    text = F.lit(None).cast("string")
    flag = F.lit(None).cast("boolean")
    row = lambda label, name, description, ok, ref: (ids[label].alias("id"), F.lit(label).alias("label"), name.alias("name"), F.col("grade"), description.alias("description"), ok.alias("glossary_validated"), ref.alias("materi_pokok_ref"))
    nodes = books.select(*row("Grade", F.col("grade"), text, flag, text))
    nodes = nodes.union(last_wins(c, ["grade", "chapter"], ["chapter_pos"]).select(*row("Chapter", F.col("chapter"), F.col("summary"), flag, text)))
    nodes = nodes.union(s.select("grade", "chapter", "subtopic").distinct().select(*row("Subtopic", F.col("subtopic"), text, flag, text)))
    nodes = nodes.union(last_wins(k, ["grade", "name"], order).select(*row("Concept", F.col("name"), F.col("description"), F.col("glossary_validated"), F.col("materi_pokok_ref"))))
    link = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("rel_type")).where("src is not null and dst is not null").distinct()
    edges = link(c, ids["Grade"], ids["Chapter"], "HAS_CHAPTER").union(link(s, ids["Chapter"], ids["Subtopic"], "HAS_SUBTOPIC")).union(link(k, ids["Subtopic"], ids["Concept"], "HAS_CONCEPT"))
    following = c.withColumn("next", F.lead("chapter").over(Window.partitionBy("grade").orderBy("chapter_pos"))).where("next is not null")
    return nodes, edges.union(link(following, ids["Chapter"], F.concat_ws("\x1f", "grade", "next"), "NEXT_CHAPTER"))


def toc_skeleton(toc: DataFrame) -> DataFrame:
    """Distinct Bab, SubBab, SubSubBab nodes of (document, bab, subbab, subsubbab) rows; null and empty levels give none."""
    levels = [("Bab", ["bab"]), ("SubBab", ["bab", "subbab"]), ("SubSubBab", ["bab", "subbab", "subsubbab"])]
    out = None
    for label, cols in levels:
        rows = toc.where(F.nullif(F.trim(F.col(cols[-1])), F.lit("")).isNotNull())
        rows = rows.select(F.concat_ws("\x1f", "document", *cols).alias("id"), F.lit(label).alias("label"), F.col(cols[-1]).alias("name"), "document").distinct()
        out = rows if out is None else out.union(rows)
    return out


def attach(rows: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Concepts under the most specific level they name, only where their Bab was seeded."""
    seeded = skeleton.where("label = 'Bab'").select("document", F.col("name").alias("bab"))
    level = F.coalesce(
        F.when(either("subsubbab", F.lit(None)).isNotNull(), F.concat_ws("\x1f", "document", "bab", "subbab", "subsubbab")), F.when(either("subbab", F.lit(None)).isNotNull(), F.concat_ws("\x1f", "document", "bab", "subbab")), F.concat_ws("\x1f", "document", "bab")
    )
    return rows.join(seeded, ["document", "bab"], "left_semi").withColumn("parent", level)


def skipped(rows: DataFrame) -> DataFrame:
    """Rows whose Bab is named as one, and not: the skip counters of a load."""
    named = F.col("bab").startswith("Bab ") | F.col("bab").startswith("BAB ")
    return rows.agg(F.sum(F.coalesce(named, F.lit(False)).cast("long")).alias("named"), F.sum((~F.coalesce(named, F.lit(False))).cast("long")).alias("skipped"))


def resolved(rows: DataFrame, known: DataFrame, keys: list[str], hit: Column, miss: Column) -> DataFrame:
    """rows with dst and target_label: ``hit`` and Concept where the keys are known, ``miss`` and ConceptTarget elsewhere."""
    out = rows.join(known.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left")
    at = lambda a, b: F.when(F.col("_known"), a).otherwise(b)
    return out.withColumns({"dst": at(hit, miss), "target_label": at(F.lit("Concept"), F.lit("ConceptTarget"))}).drop("_known")


def concept_relations(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stubs): targets that are concepts of the same book point to them, others to ConceptTarget stubs."""
    t = triples(books).where(F.nullif(F.trim("target"), F.lit("")).isNotNull())
    known = concepts(books).select("grade", F.col("name").alias("target"))
    t = resolved(t, known, ["grade", "target"], concept_id(F.col("target"), F.col("grade")), F.concat(F.lit("?"), "target"))
    edges = t.select(
        concept_id(F.col("concept"), F.col("grade")).alias("src"), "dst", relation_type(F.col("relation")).alias("rel_type"), F.col("relation").alias("original_type"), "target_label",
        F.col("r.description").alias("description"), F.col("r.confidence").alias("confidence"), F.coalesce("r.provenance", F.lit("extraction")).alias("provenance"),
        F.to_json("r.expert_review").alias("expert_review_json"), "index", "grade",
    )
    edges = last_wins(edges, ["src", "dst", "rel_type"], ["grade", "index"])
    stubs = edges.where("target_label = 'ConceptTarget'").select(F.col("dst").alias("id"), F.lit("ConceptTarget").alias("label"), F.substring("dst", 2, 1_000_000).alias("name")).distinct()
    return edges, stubs


def promote_stubs(stubs: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, mapping): stubs whose name is a concept's, whatever the case, are replaced by it; ties to the least id."""
    c = nodes.where("label = 'Concept'").groupBy(name_key(F.col("name")).alias("key")).agg(F.min("id").alias("to"))
    mapping = stubs.select("id", name_key(F.col("name")).alias("key")).join(c, "key").select("id", "to")
    return edges.join(mapping.toDF("dst", "to"), "dst", "left").withColumn("dst", F.coalesce("to", "dst")).select(*edges.columns), mapping


def merge_variants(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes whose names differ in case or spaces become the one with the longest description; edges follow."""
    key = ["label", "grade", name_key(F.col("name"))]
    best = first_wins(nodes, key, [F.desc(F.length(F.coalesce("description", F.lit("")))), "id"])
    to = nodes.select("id", name_key(F.col("name")).alias("key"), "label", "grade").join(best.select(F.col("id").alias("to"), name_key(F.col("name")).alias("key"), "label", "grade"), ["key", "label", "grade"]).select("id", "to")
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(to.toDF(end, "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return best, moved.select(*edges.columns).where("src <> dst").distinct()


def chapter_relations(books: DataFrame) -> DataFrame:
    """src, dst, rel_type, description of relations between existing chapters of a book (K15); the explanation stands in for a description."""
    c = books.select("grade", F.explode("chapters").alias("c"))
    known = c.select("grade", F.col("c.chapter").alias("target")).distinct()
    r = c.select("grade", F.col("c.chapter").alias("chapter"), F.explode("c.chapter_relations").alias("r"))
    r = r.select("grade", "chapter", F.col("r.target_chapter").alias("target"), relation_type(F.col("r.type")).alias("rel_type"), either(F.col("r.description"), F.col("r.explanation")).alias("description"))
    return r.join(known, ["grade", "target"], "left_semi").select(F.concat_ws("\x1f", "grade", "chapter").alias("src"), F.concat_ws("\x1f", "grade", "target").alias("dst"), "rel_type", "description")


def cross_book_links(books: DataFrame, default_type: str = "BERKAITAN_DENGAN") -> tuple[DataFrame, DataFrame]:
    """(links, counters): trimmed links to other known books; counters of links to the same and to unknown books."""
    k = concepts(books).select("grade", F.col("name").alias("concept"), F.explode("cross_book_links").alias("l"))
    known = books.select(F.col("grade").alias("target_book"), F.lit(True).alias("known")).distinct()
    k = k.select(
        "grade", "concept", F.trim("l.target_book").alias("target_book"), F.trim("l.target_concept").alias("target_concept"),
        F.coalesce(F.nullif(F.trim("l.relation_type"), F.lit("")), F.lit(default_type)).alias("rel_type"), F.col("l.confidence").alias("confidence"), F.col("l.explanation").alias("explanation"),
    ).join(known, "target_book", "left")
    same, unknown = F.col("grade") == F.col("target_book"), F.col("known").isNull()
    counters = k.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("same_book", same), ("unknown_book", unknown & ~F.coalesce(same, F.lit(False))))])
    return k.where(F.col("known") & ~same & (F.col("target_concept") != "")).drop("known"), counters


def variables(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variable nodes, USES_VARIABLE edges, SHARES_VARIABLE edges): one edge for each variable two concepts share."""
    v = nodes.select("id", F.explode("variables").alias("text")).select("id", variable(F.col("text")).alias("v")).where("v is not null").select("id", "v.*")
    found = v.groupBy("name").agg(F.max("label").alias("label"), F.max("unit").alias("unit"))
    uses = v.select(F.col("id").alias("src"), F.col("name").alias("dst"), F.lit("USES_VARIABLE").alias("rel_type")).distinct()
    a, b = uses.select(F.col("src").alias("a"), F.col("dst").alias("variable")), uses.select(F.col("src").alias("b"), F.col("dst").alias("variable"))
    return found, uses, a.join(b, "variable").where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SHARES_VARIABLE").alias("rel_type"), "variable")


def _used(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.explode("variables").alias("text")).select("id", variable(F.col("text"))["name"].alias("v")).where("v is not null")


def concepts_sharing(nodes: DataFrame, least: int = 1) -> DataFrame:
    """a, b, shared (names): pairs of concepts that use ``least`` or more of the same variables, whatever the number of concepts that use one."""
    v = _used(nodes)
    return overlap_pairs(v.groupBy("id").agg(F.collect_set("v").alias("tokens")).withColumn("grp", F.lit(None).cast("string")), least)


def sharing_counts(nodes: DataFrame, least: int = 1) -> DataFrame:
    """a, b, shared (how many): as ``concepts_sharing``, without the names."""
    return overlap_counts(_used(nodes).select("id", F.col("v").alias("token")), least)


def topics_as_concepts(topics: DataFrame) -> DataFrame:
    """Old (topic, subtopics[]) rows in the shape of concepts."""
    return topics.select(F.col("topic").alias("name"), F.transform("subtopics", lambda s: F.struct(F.lit("BAGIAN_DARI").alias("type"), s.alias("target"))).alias("relations"))


def find_subtopic(wanted: DataFrame, books: DataFrame) -> DataFrame:
    """wanted (grade, needle) with the first subtopic whose name contains it, whatever the case."""
    s = subtopics(books).select("grade", "chapter_pos", "chapter", "subtopic_pos", F.col("s.name").alias("subtopic"))
    hit = wanted.join(s, "grade").where(F.instr(F.lower("subtopic"), F.lower("needle")) > 0)
    return first_wins(hit, ["grade", "needle"], ["chapter_pos", "subtopic_pos"])


def missing_only(rows: DataFrame, existing: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows whose key is not there yet (K23, K24): by lower-case name, or by concept and target."""
    with_keys = lambda df: df.withColumns({f"_{k}": c for k, c in keys.items()})
    names = [f"_{k}" for k in keys]
    return with_keys(rows).join(with_keys(existing).select(*names).distinct(), names, "left_anti").drop(*names)


def reviewed(rows: DataFrame, actions: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, dropped, operations) of indexed triples under review actions by (grade, index); indexes are matched before anything moves."""
    a = actions.select("grade", "index", "action", "consensus", "n_reviewers")
    joined = rows.join(a, ["grade", "index"], "left").withColumn("action", F.coalesce("action", F.lit("keep")))
    names = [c for c in rows.columns if c != "r"]
    added = proposed.select("grade", F.lit(None).cast("long").alias("index"), "chapter", F.lit(None).cast("string").alias("subtopic"), F.col("subject").alias("concept"), "relation", "target")
    kept = joined.where("action <> 'drop'").select(*names, "action", "consensus", "n_reviewers")
    kept = kept.unionByName(added.withColumns({"action": F.lit("add"), "consensus": F.lit("missing"), "n_reviewers": F.lit(None).cast("long")}))
    operations = joined.select("grade", "action").unionByName(added.select("grade", F.lit("add").alias("action")))
    return kept, joined.where("action = 'drop'").select(*names), operations.groupBy("grade").pivot("action", ["keep", "annotate", "drop", "add"]).count().na.fill(0)


def rebuilt(rows: DataFrame) -> DataFrame:
    """Triples (grade, chapter, subtopic, concept, relation, target, index) as nested books again, in index order."""
    inner = rows.groupBy("grade", "chapter", "subtopic", "concept").agg(F.min("index").alias("at"), F.sort_array(F.collect_list(F.struct("index", F.col("relation").alias("type"), "target"))).alias("relations"))
    pack = lambda df, keys, name, item, list_: df.groupBy(*keys).agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", F.col(name).alias(item), list_))).alias(f"{item}s"))
    s = pack(inner, ["grade", "chapter", "subtopic"], "concept", "concept", "relations")
    c = pack(s, ["grade", "chapter"], "subtopic", "subtopic", "concepts")
    return pack(c, ["grade"], "chapter", "chapter", "subtopics").drop("at")


def completed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Triples without the filler of concepts that got a link, with the accepted links added and routed same-book or cross-book."""
    linked = found.select("grade", "concept").distinct().withColumn("linked", F.lit(True))
    filler = F.coalesce(F.col("r.expert_validation_added"), F.lit(False)) & F.coalesce("linked", F.lit(False))
    old = rows.join(linked, ["grade", "concept"], "left").where(~filler).select("grade", "concept", "relation", "target", F.lit("same").alias("route"))
    route = F.when(F.col("grade") == F.col("target_grade"), "same").otherwise("cross")
    return old.unionByName(found.select("grade", "concept", "relation", "target", route.alias("route")))
