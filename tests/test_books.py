"""Nested books, loads, reviewed builds and parsers on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import schemas
from loomgraph.functions import parsers
from loomgraph.functions import text as T
from loomgraph.operators import books as B
from loomgraph.operators import upsert as U
from loomgraph.sources import files


def concept(name, relations=(), links=(), description="d"):
    return {
        "name": name, "description": description, "relations": [{"type": t, "target": g, "expert_validation_added": f} for t, g, f in relations],
        "cross_book_links": [{"target_book": b, "target_concept": c, "relation_type": t, "confidence": 0.9} for b, c, t in links],
    }


BOOKS = [
    {"grade": "Bio", "chapters": [
        {"chapter": "Bab 1", "chapter_summary": "s", "subtopics": [
            {"name": "Sel", "concepts": [concept("Sel", [("terdiri dari", "Inti", False), ("bagian-dari", "Gerak", False)]), concept("Inti", [("X", "Sel", True)], [("Fis", " Gaya ", ""), ("Bio", "Sel", "A"), ("Kim", "x", "A")])]},
            {"name": "Kosong", "concepts": []}]},
        {"chapter": "Bab 2", "subtopics": [{"name": "Gerak", "concepts": [concept("Energi", [("memuat", "energi kimia", False)])]}],
         "chapter_relations": [{"type": "PRASYARAT", "target_chapter": "Bab 1", "explanation": "why"}, {"type": "PRASYARAT", "target_chapter": "Bab 9"}]}]},
    {"grade": "Fis", "chapters": [{"chapter": "Bab 1", "subtopics": [{"name": "Energi", "concepts": [concept("Energi", description=""), concept("Energi", description="second"), concept("Gaya")]}]}]},
]


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    for k, b in enumerate(BOOKS):
        (path / f"{k}.json").write_text(json.dumps(b, indent=1))
    return files.books(spark, str(path))


def test_flattening_is_depth_first(books):
    rows = B.triples(books).where("grade = 'Bio'").orderBy("index").collect()
    assert [(r["index"], r.concept, r.relation, r.target) for r in rows] == [(0, "Sel", "terdiri dari", "Inti"), (1, "Sel", "bagian-dari", "Gerak"), (2, "Inti", "X", "Sel"), (3, "Energi", "memuat", "energi kimia")]
    assert B.concepts(books).count() == 6
    assert {r.grade: (r.chapters, r.subtopics, r.concepts) for r in B.granularity(books).collect()} == {"Bio": (2, 3, 3), "Fis": (1, 1, 3)}


def test_structure_keeps_same_names_of_two_books_apart(books):
    nodes, edges = B.structure(books)
    rows = {(r.label, r.grade, r.name): r.description for r in nodes.collect()}
    assert rows["Concept", "Fis", "Energi"] == "second" and rows["Concept", "Bio", "Energi"] == "d"
    kinds = {r.rel_type: r.n for r in edges.groupBy("rel_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"HAS_CHAPTER": 3, "HAS_SUBTOPIC": 4, "HAS_CONCEPT": 5, "NEXT_CHAPTER": 1}


def test_targets_resolve_or_become_stubs(books):
    edges, stubs = B.concept_relations(books)
    assert {(r.rel_type, r.target_label) for r in edges.collect()} == {("TERDIRI_DARI", "Concept"), ("BAGIAN_DARI", "ConceptTarget"), ("X", "Concept"), ("MEMUAT", "ConceptTarget")}
    assert {r.name for r in stubs.collect()} == {"Gerak", "energi kimia"}
    assert [r.description for r in B.chapter_relations(books).collect()] == ["why"]


def test_cross_links_are_cleaned_and_counted(books):
    links, counters = B.cross_book_links(books)
    assert [(r.target_book, r.target_concept, r.rel_type) for r in links.collect()] == [("Fis", "Gaya", "BERKAITAN_DENGAN")]
    assert tuple(counters.first()) == (1, 1)


def test_reviewed_build_and_rebuild(spark, books):
    rows = B.triples(books)
    actions = spark.createDataFrame([("Bio", 1, "drop", "wrong", 2), ("Bio", 0, "annotate", "partial", 1)], "grade string, index long, action string, consensus string, n_reviewers long")
    proposed = spark.createDataFrame([("Fis", "Bab 1", "Gaya", "MEMPENGARUHI", "Energi")], "grade string, chapter string, subject string, relation string, target string")
    kept, dropped, operations = B.reviewed(rows, actions, proposed)
    assert [r.target for r in dropped.collect()] == ["Gerak"] and kept.count() == 4
    ops = {r.grade: (r["keep"], r.annotate, r["drop"], r["add"]) for r in operations.collect()}
    assert ops == {"Bio": (2, 1, 1, 0), "Fis": (0, 0, 0, 1)}
    again = B.rebuilt(rows).where("grade = 'Bio'").first()
    assert [c.chapter for c in again.chapters] == ["Bab 1", "Bab 2"] and [r.target for r in again.chapters[0].subtopics[0].concepts[0].relations] == ["Inti", "Gerak"]


def test_completion_drops_filler_of_linked_concepts(spark, books):
    found = spark.createDataFrame([("Bio", "Inti", "SAMA_DENGAN", "Gaya", "Fis")], "grade string, concept string, relation string, target string, target_grade string")
    rows = {(r.concept, r.target, r.route) for r in B.completed(B.triples(books), found).collect()}
    assert ("Inti", "Sel", "same") not in rows and ("Inti", "Gaya", "cross") in rows and ("Sel", "Inti", "same") in rows


def test_stubs_are_promoted_and_variants_merged(spark):
    nodes = spark.createDataFrame([("1", "Concept", "Gerak Lurus", "F", "long text"), ("2", "Concept", "gerak  lurus", "F", ""), ("3", "Concept", "Gaya", "F", None)], "id string, label string, name string, grade string, description string")
    edges = spark.createDataFrame([("3", "?gaya"), ("1", "2"), ("3", "2")], "src string, dst string")
    stubs = spark.createDataFrame([("?gaya", "GAYA "), ("?x", "x")], "id string, name string")
    moved, mapping = B.promote_stubs(stubs, nodes, edges)
    assert {(r.src, r.dst) for r in moved.collect()} == {("3", "3"), ("1", "2"), ("3", "2")} and mapping.count() == 1
    kept, links = B.merge_variants(nodes, edges.where("dst <> '?gaya'"))
    assert {r.id for r in kept.collect()} == {"1", "3"} and [(r.src, r.dst) for r in links.collect()] == [("3", "1")]


def test_variables_and_skeleton(spark):
    nodes = spark.createDataFrame([("a", ["F (gaya, N)", "v"]), ("b", ["F (gaya, N)", " "]), ("c", None)], "id string, variables array<string>")
    found, uses, shared = B.variables(nodes)
    assert {(r.name, r.label, r.unit) for r in found.collect()} == {("F", "gaya", "N"), ("v", "", "")}
    assert uses.count() == 3 and [(r.src, r.dst, r.variable) for r in shared.collect()] == [("a", "b", "F")]
    toc = spark.createDataFrame([("d", "Bab 1", "A", None), ("d", "Bab 1", "", None), ("d", None, None, None)], "document string, bab string, subbab string, subsubbab string")
    skeleton = B.toc_skeleton(toc)
    assert {(r.label, r.name) for r in skeleton.collect()} == {("Bab", "Bab 1"), ("SubBab", "A")}
    rows = spark.createDataFrame([("d", "Bab 1", "A", "", "k"), ("d", "Bab 7", None, None, "l")], "document string, bab string, subbab string, subsubbab string, name string")
    assert [r.parent.split("\x1f") for r in B.attach(rows, skeleton).collect()] == [["d", "Bab 1", "A"]]
    assert tuple(B.skipped(rows.union(spark.createDataFrame([("d", "x", None, None, "m")], rows.schema))).first()) == (2, 1)


def test_find_subtopic_and_missing_only(spark, books):
    wanted = spark.createDataFrame([("Bio", "SEL"), ("Bio", "nothing")], "grade string, needle string")
    assert [(r.needle, r.subtopic) for r in B.find_subtopic(wanted, books).collect()] == [("SEL", "Sel")]
    new = spark.createDataFrame([("sel",), ("baru",)], "name string")
    assert [r.name for r in B.missing_only(new, B.concepts(books).select("name"), {"k": F.lower("name")}).collect()] == ["baru"]


def test_upsert_twice_is_once_and_replay_rejects(spark):
    edges = spark.createDataFrame([("A\x1fa", "B\x1fb", "T", "old", 0.5, "m")], "src string, dst string, rel_type string, description string, confidence double, method string")
    dump = spark.createDataFrame(
        [("T", "a", "A", "b", "B", ("new", None, 0.9, None)), ("", "a", "A", "b", "B", ("x", None, 0.1, None)), ("T", "a", "A", "a", "A", ("x", None, 0.1, None))],
        "rel_type string, source_name string, source_grade string, target_name string, target_grade string, properties struct<description:string,relation_type:string,confidence:double,method:string>",
    )
    once, rejected = U.replay(edges, dump, "replay")
    twice, _ = U.replay(once, dump, "replay")
    assert [tuple(r) for r in once.collect()] == [tuple(r) for r in twice.collect()] == [("A\x1fa", "B\x1fb", "T", "new", 0.9, "replay")]
    assert {r.reason for r in rejected.collect()} == {"no relation type", "self loop"}
    poor = spark.createDataFrame([("A\x1fa", "B\x1fb", "T", " ", None, None)], edges.schema)
    assert U.upsert(edges, poor, ["src", "dst", "rel_type"], keep_non_empty=True).first().description == "old"
    stored = spark.createDataFrame([("n", "m", [1.0, 2.0]), ("o", "m", [1.0])], "node_id string, model string, vector array<float>")
    assert tuple(U.index_meta(stored).first()) == ("m", 2, 2, False)
    with pytest.raises(ValueError, match="another length"):
        U.require_dimension(stored, "m", 2)
    with pytest.raises(ValueError, match="vocabulary"):
        U.guard_vocabulary(edges, ("X",))
    sims = U.upsert_similar(spark.createDataFrame([], "src string, dst string, rel_type string, score double"), spark.createDataFrame([("z", "a", 0.8), ("a", "z", 0.9)], "a string, b string, score double"))
    assert [tuple(r) for r in sims.collect()] == [("a", "z", "SIMILAR_TO", 0.9)]


def test_staged_dump_refuses_to_overwrite(spark, tmp_path):
    edges = U.staged(spark.createDataFrame([("PX_T", "a"), ("none", "b"), ("PX_T", "c"), ("PX_U", "d")], "rel_type string, n string"), "PX_")
    row = U.write_staged(edges, str(tmp_path / "dump"), {"version": "1"})
    assert row.first().edge_count == 3 and list(row.first().edge_type_breakdown.items()) == [("T", 2), ("U", 1)]
    with pytest.raises(Exception, match="exists"):
        U.write_staged(edges, str(tmp_path / "dump"), {"version": "1"})


def test_scalar_functions(spark):
    df = spark.createDataFrame([("XIV", "12", "x")], "r string, n string, t string")
    row = df.select(T.roman(F.col("r")), T.page_label(F.col("n")), T.page_label(F.lit("IV")), T.page_label(F.lit("??")), T.percentage(F.lit(0.125), 0), T.relation_type(F.lit("   ")))
    assert tuple(row.first()) == (14, 12, 4, 0, "12.0%", "RELATED_TO")
    edge = lambda t, x, c: F.struct(F.lit(t).alias("rel_type"), F.lit(x).alias("target"), F.lit(c).cast("double").alias("confidence"))
    row = df.select(
        T.distinct_ignoring_case(F.array(F.lit("A"), F.lit("b"), F.lit("a"))), T.without_contained(F.array(F.lit("sel"), F.lit("sel hewan"))), T.without_prefix(F.lit("PX_a"), "PX_"),
        T.heading_level(F.lit("BAB I Sel"), F.lit(14.0), F.lit(0), F.lit(10.0)), T.heading_level(F.lit("A. Sub"), F.lit(10.0), F.lit(16), F.lit(10.0)), T.heading_level(F.lit("teks"), F.lit(10.0), F.lit(0), F.lit(10.0)),
        T.edge_lines(F.array(edge("T", "x", 0.5), edge("U", "y", None)), 1), T.model_dimension(F.lit("Text-Embedding-3-LARGE")), T.older_than(F.lit("2026-01-01"), F.lit("2026-02-15").cast("date"), 30),
    ).first()
    assert tuple(row) == (["A", "b"], ["sel hewan"], "a", "bab", "subbab", "body", '  - T → "x" (conf: 0.50)\n  +1 more', 3072, True)
    vectors = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in vectors.select(T.cosine("a", "b")).collect()] == [1.0, None] and vectors.select(T.unit("a")).first()[0] == [0.6, 0.8]
    none = F.array().cast("array<struct<rel_type:string,target:string,confidence:double>>")
    around = lambda chapter, edges: T.neighbourhood(F.lit("p"), chapter, edges, F.lit("q"), F.lit("c"), none, F.array(F.lit("s")))
    block = df.select(T.pair_block(F.lit(3), {"name": F.col("t")}, {"name": F.lit("")}, around(F.lit("c"), F.array(edge("T", "x", None))))).first()[0]
    assert block.startswith("Pair 3\nA name: x\n====") and 'Konsep B ("q") berada di Bab: c (Bab yang sama)' in block and '  - T → "x"\n' in block and "dirujuk A dan B): s" in block
    assert df.select(T.neighbourhood(F.lit("p"), F.lit(""), none, F.lit("q"), F.lit(None).cast("string"), none, F.array().cast("array<string>"))).first()[0] == ""
    cleaned = df.select(T.clean_text(F.lit("bio-\n  logi\tsel 12 BIOLOGI XI abc  DNA é x1"))).first()[0]
    assert cleaned == "biologi sel abc é x1"


def test_parsers(spark):
    toc = "Daftar Isi\nBab 1 Sel ........ 3\nA. Inti ..... 4\nBab II Gerak ...... 20\nB. Laju ....... 25\nBab III Daftar Gambar .... 90\n"
    colon = "Glosarium\n12\n" + "\n".join(f"istilah{k}: artinya panjang sekali nomor {k}" for k in range(6)) + "\nlanjutan baris"
    plain = "Glosarium\nampere Satuan pokok untuk arus\ndalam sistem.\nwaktu paruh\nWaktu yang diperlukan."
    rows = [("b", 2, toc), ("b", 98, "before: not a term at all"), ("b", 99, colon), ("b", 100, "Indeks\nzzz: nothing of it"), ("c", 5, plain), ("n", 1, None)]
    pages = spark.createDataFrame(rows, "book string, page int, text string")
    chapters = parsers.toc_chapters(pages).orderBy("position").collect()
    assert [(r.name, r.page_start, r.position, [(s.label, s.name, s.page_start) for s in r.subchapters]) for r in chapters] == [("Sel", 3, 1, [("A", "Inti", 4)]), ("Gerak", 20, 2, [("B", "Laju", 25)])]
    terms = {(r.book, r.term): r.definition for r in parsers.glossary(pages).collect()}
    assert len(terms) == 8 and terms["b", "istilah5"] == "artinya panjang sekali nomor 5 lanjutan baris"
    assert terms["c", "ampere"] == "Satuan pokok untuk arus dalam sistem." and terms["c", "waktu paruh"] == "Waktu yang diperlukan."
    text = " ".join(f"Kata {k} dua tiga." for k in range(10))
    parts = parsers.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "text", 12, 4).orderBy("part").collect()
    assert parts[0].chunk == "Kata 0 dua tiga. Kata 1 dua tiga. Kata 2 dua tiga." and parts[1].chunk.startswith("Kata 2") and parts[-1].chunk.endswith("Kata 9 dua tiga.")


def _glossary(spark, lines, least=15):
    pages = spark.createDataFrame([("b", 1, "Glosarium disebut di sini"), *[("b", 40 + k, x) for k, x in enumerate(("Glosarium\n7\n" + lines).split("\f"))], ("b", 80, "Daftar Pustaka\nulang: tidak dibaca lagi di sini")], "book string, page int, text string")
    pages = pages.union(spark.createDataFrame([("b", k, "isi") for k in range(81, 85)], pages.schema))
    return {r.term: r.definition for r in parsers.glossary(pages, least=least).collect()}


def test_glossary_formats(spark):
    got = _glossary(spark, """akar-rata-rata-kuadrat (rms) Akar kuadrat dari rerata kuadrat nilai
ampere Satuan pokok untuk arus dalam sistem
internasional.
ATP (adenosin trifosfat) molekul yang membawa energi dalam sel
arus bolak-balik
Arus yang arahnya membalik secara
teratur.
gelombang
elektromagnetik
Gelombang dari medan listrik dan medan mag-
net yang berosilasi.
waktu paruh t½ Waktu sampai separuh inti meluruh
gen intermediet gen yang pengaruhnya berada di tengah
\frheostat
Jenis resistor yang nilainya dapat diubah.
12
Pendek""")
    assert got == {
        "akar-rata-rata-kuadrat (rms)": "Akar kuadrat dari rerata kuadrat nilai", "ampere": "Satuan pokok untuk arus dalam sistem internasional.", "ATP (adenosin trifosfat)": "molekul yang membawa energi dalam sel",
        "arus bolak-balik": "Arus yang arahnya membalik secara teratur.", "gelombang elektromagnetik": "Gelombang dari medan listrik dan medan magnet yang berosilasi.", "waktu paruh t½": "Waktu sampai separuh inti meluruh",
        "gen": "intermediet gen yang pengaruhnya berada di tengah", "rheostat": "Jenis resistor yang nilainya dapat diubah. Pendek",
    }
    got = _glossary(spark, """monomer: satuan pembentuk rantai panjang
yang berulang
reaksi
polimerisasi: reaksi yang menggabung monomer
isomer:
senyawa dengan rumus molekul sama
ester: turunan asam dengan gugus alkil
eter: senyawa dengan atom oksigen di tengah
keton: senyawa dengan gugus karbonil di dalam rantai
asam: pendek""")
    assert got == {
        "monomer": "satuan pembentuk rantai panjang yang berulang", "reaksi polimerisasi": "reaksi yang menggabung monomer", "isomer": "senyawa dengan rumus molekul sama",
        "ester": "turunan asam dengan gugus alkil", "eter": "senyawa dengan atom oksigen di tengah", "keton": "senyawa dengan gugus karbonil di dalam rantai",
    }
    assert _glossary(spark, "satu Dua") == {}


def test_subject_matter_in_four_formats(spark):
    chapters = spark.createDataFrame([("g", 1, "LISTRIK STATIS", [("Muatan Listrik",), ("b. Medan Listrik",)]), ("g", 2, "ARUS DAN TEGANGAN SEARAH", [("Hukum Ohm",)])], "book string, position int, name string, subchapters array<struct<name:string>>")
    pages = [
        (1, "Pendahuluan\nPeserta didik membaca Kata Pengantar"),
        (2, "BAB 1 | Listrik Statis\nTujuan Pembelajaran\n2\nGaya Coulomb antara\nDua Muatan\nPeserta\ndidik\nmampu menghitung gaya\n4 Hukum Gauss Peserta didik menerapkan hukum"),
        (3, "Medan Listrik\n3 Garis Gaya dan\nKuat Medan\nPeserta didik menggambar garis\nMateri Pokok\n2\nPotensial Listrik\n1 Kapasitor Keping Sejajar\nSumber belajar"),
        (4, "Kata penutup\n- Rangkaian Seri\n- Rangkaian Paralel\nPeserta didik merangkai"),
        (5, "bab 9 | tegangan searah dan arus\nHukum Ohm\n2\nPeserta didik mengukur\nPokok Materi\nKuat Arus\nHambatan Jenis Kawat\nhttp://x.id"),
        (6, "Daya Listrik Rumah\nlain"),
    ]
    got = [(r.chapter, r.item) for r in parsers.subject_matter(spark.createDataFrame([("g", *p) for p in pages], "book string, page int, text string"), chapters).orderBy("book", "chapter", "position").collect()]
    first, second = [i for c, i in got if c == "LISTRIK STATIS"], [i for c, i in got if c != "LISTRIK STATIS"]
    assert first == ["Gaya Coulomb antara Dua Muatan", "Hukum Gauss", "Garis Gaya dan Kuat Medan", "Potensial Listrik", "Kapasitor Keping Sejajar", "Rangkaian Seri", "Rangkaian Paralel"]
    assert second == ["Hukum Ohm", "Kuat Arus", "Hambatan Jenis Kawat"]
    fine = ["Gaya Listrik antara 2 Muatan Listrik", "Hukum Gauss"]
    bad = ["hukum Gauss", "Hukum", "Apa itu Gaya?", "Rangkaian Seri Rangkaian Paralel", "GEM Spektrum GEM", "Kegiatan Awal", "Sel Sel Sel Hewan", "Anda dapat melihat ini", "Satu dua tiga empat lima enam tujuh delapan sembilan sepuluh a b c"]
    assert all(map(parsers.is_subject, fine)) and not any(map(parsers.is_subject, bad))


def test_schemas_parse(spark):
    for s in (schemas.BOOK, schemas.EDGE_DUMP, schemas.REVIEW_FILE, schemas.NODES, schemas.EDGES, schemas.EMBEDDINGS):
        assert spark.createDataFrame([], s).count() == 0
    assert schemas.spec("b").vocabulary(spark).where("symmetric").count() == 2
    with pytest.raises(KeyError):
        schemas.spec("x")
