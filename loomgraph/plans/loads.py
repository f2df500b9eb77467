"""Loads, replays, reviewed builds and listings: parts are concepts of brands (documents) and types (chapters), line items their relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as T
from ..operators import books as B
from ..operators import candidates as C
from ..operators import classify as L
from ..operators import metrics as M
from ..operators import upsert as U
from ..operators.tables import cut
from .similarity import _SCORED, _grades, _top

_TOC = """t as (select p_partkey, p_brand as document, case when p_size % 5 = 0 then null when p_size % 7 = 0 then 'Lain' else 'Bab ' || (p_size % 4) end as bab,
  case when p_size % 3 = 0 then ' ' when p_size % 3 = 1 then p_type end as subbab, case when p_size % 6 = 1 then p_name else '' end as subsubbab from part)"""


def _toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    return p.select(
        "p_partkey", F.col("p_brand").alias("document"), F.when(size % 5 == 0, None).when(size % 7 == 0, "Lain").otherwise(F.concat(F.lit("Bab "), size % 4)).alias("bab"),
        F.when(size % 3 == 0, " ").when(size % 3 == 1, F.col("p_type")).alias("subbab"), F.when(size % 6 == 1, F.col("p_name")).otherwise("").alias("subsubbab"),
    )


@query("toc_skeleton", f"""with {_TOC} select 'Bab' as label, concat_ws(chr(31), document, bab) as id, bab as name from t where nullif(trim(bab), '') is not null
union select 'SubBab', concat_ws(chr(31), document, bab, subbab), subbab from t where nullif(trim(subbab), '') is not null
union select 'SubSubBab', concat_ws(chr(31), document, bab, subbab, subsubbab), subsubbab from t where nullif(trim(subsubbab), '') is not null""")
def toc_skeleton(spark, sf_dir):
    return B.toc_skeleton(_toc(spark, sf_dir)).select("label", "id", "name")


@query("toc_load", f"""with {_TOC}, s as (select distinct document, bab from t where p_partkey % 2 = 0 and bab is not null)
select p_partkey, concat_ws(chr(31), document, bab, case when nullif(subbab, '') is not null or subsubbab <> '' then coalesce(subbab, null) end, nullif(subsubbab, '')) as parent from t semi join s using (document, bab)""")
def toc_load(spark, sf_dir):
    toc = _toc(spark, sf_dir)
    return B.attach(toc, B.toc_skeleton(toc.where("p_partkey % 2 = 0"))).select("p_partkey", "parent")


@query("toc_skipped", f"with {_TOC} select cast(count(*) filter (bab like 'Bab %' or bab like 'BAB %') as bigint) as named, cast(count(*) filter (not coalesce(bab like 'Bab %' or bab like 'BAB %', false)) as bigint) as skipped from t")
def toc_skipped(spark, sf_dir):
    return B.skipped(_toc(spark, sf_dir))


_CONCEPTS = "c as (select 'p' || p_partkey as id, 'Concept' as label, case when p_partkey % 2 = 0 then upper(p_name) else ' ' || p_name || ' ' end as name, p_brand as grade, p_type as description from part)"


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Concept").alias("label"), name.alias("name"), F.col("p_brand").alias("grade"), F.col("p_type").alias("description"))


@query("stub_promotion", f"""with {_CONCEPTS}, s as (select distinct '?' || split_part(p_name, ' ', 1) || case when p_size % 2 = 0 then ' ' || split_part(p_name, ' ', 2) else '' end as id from part),
m as (select s.id, min(c.id) as target from s join c on lower(trim(c.name)) = lower(substr(s.id, 2)) group by 1),
e as (select 'p' || p_partkey as src, '?' || split_part(p_name, ' ', 1) || case when p_size % 2 = 0 then ' ' || split_part(p_name, ' ', 2) else '' end as dst from part)
select e.src, coalesce(m.target, e.dst) as dst from e left join m on m.id = e.dst""")
def stub_promotion(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    stub = F.concat(F.lit("?"), words[0], F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), words[1])).otherwise(""))
    edges = p.select(F.concat(F.lit("p"), "p_partkey").alias("src"), stub.alias("dst"))
    stubs = edges.select(F.col("dst").alias("id"), F.substring("dst", 2, 1_000_000).alias("name")).distinct()
    moved, _ = B.promote_stubs(stubs, _concepts(spark, sf_dir), edges)
    return moved


@query("variant_merge", f"""with {_CONCEPTS}, k as (select *, row_number() over (partition by label, grade, lower(trim(name)) order by length(description) desc, id) as r from c),
t as (select k.id, b.id as kept from k join k b on b.r = 1 and b.grade = k.grade and lower(trim(b.name)) = lower(trim(k.name))),
e as (select 'p' || l_partkey as src, 'p' || (l_suppkey * 3) as dst from lineitem)
select distinct coalesce(x.kept, src) as src, coalesce(y.kept, dst) as dst from e left join t x on x.id = src left join t y on y.id = dst where coalesce(x.kept, src) <> coalesce(y.kept, dst)""")
def variant_merge(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("p"), F.col("l_suppkey") * 3).alias("dst"))
    _, moved = B.merge_variants(_concepts(spark, sf_dir), edges)
    return moved


_TRIPLES = """t as (select grade, index, 'c' || l_suppkey as chapter, l_linestatus as subtopic, 'k' || l_partkey as concept, grade || l_linestatus as relation, 's' || l_suppkey as target, l_quantity from (
  select l_returnflag as grade, l_orderkey * 10 + l_linenumber as index, min(l_suppkey) as l_suppkey, min(l_partkey) as l_partkey, min(l_linestatus) as l_linestatus, min(l_quantity) as l_quantity from lineitem group by 1, 2))"""


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grade"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("index"))
    li = li.agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_linestatus", "l_quantity")])
    return li.select(
        "grade", "index", F.concat(F.lit("c"), "l_suppkey").alias("chapter"), F.col("l_linestatus").alias("subtopic"), F.concat(F.lit("k"), "l_partkey").alias("concept"),
        F.concat("grade", "l_linestatus").alias("relation"), F.concat(F.lit("s"), "l_suppkey").alias("target"), "l_quantity",
    )


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, s = _triples(spark, sf_dir), table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    q = F.col("l_quantity")
    actions = t.where(q <= 10).select("grade", "index", F.when(q <= 3, "drop").otherwise("annotate").alias("action"), F.when(q <= 3, "wrong").otherwise("partial").alias("consensus"), (F.col("index") % 3 + 1).alias("n_reviewers"))
    proposed = s.select(F.lit("N").alias("grade"), F.concat(F.lit("c"), "s_suppkey").alias("chapter"), F.col("s_name").alias("subject"), F.lit("T").alias("relation"), F.lit("x").alias("target"))
    return B.reviewed(t.drop("l_quantity"), actions, proposed)


@query("reviewed_build", f"""with {_TRIPLES}, a as (select *, case when l_quantity <= 3 then 'drop' when l_quantity <= 10 then 'annotate' else 'keep' end as action from t)
select grade, index, concept, relation, target, action, case action when 'annotate' then 'partial' end as consensus, case when action = 'annotate' then index % 3 + 1 end as n_reviewers from a where action <> 'drop'
union all select 'N', null, s_name, 'T', 'x', 'add', 'missing', null from supplier where s_acctbal > 5000""")
def reviewed_build(spark, sf_dir):
    kept, _, _ = _reviewed(spark, sf_dir)
    return kept.select("grade", "index", "concept", "relation", "target", "action", "consensus", "n_reviewers")


@query("reviewed_operations", f"""with {_TRIPLES}, x as (select grade, count(*) filter (l_quantity > 10) as keep, count(*) filter (l_quantity > 3 and l_quantity <= 10) as annotate, count(*) filter (l_quantity <= 3) as drop from t group by 1)
select *, case when grade = 'N' then (select count(*) from supplier where s_acctbal > 5000) else 0 end as add from x""")
def reviewed_operations(spark, sf_dir):
    _, _, operations = _reviewed(spark, sf_dir)
    return operations


@query("rebuilt_books", f"""with {_TRIPLES}, b as (select target || grade as grade, index, 'q' || cast(l_quantity as integer) as chapter, subtopic, concept, relation, target from t),
r as (select grade, chapter, subtopic, concept, string_agg(relation || '>' || target, ',' order by index, relation, target) as relations, min(index) as pos from b group by 1, 2, 3, 4)
select grade, chapter, subtopic, string_agg(concept || ':' || relations, ';' order by pos, concept) as concepts from r group by 1, 2, 3""")
def rebuilt_books(spark, sf_dir):
    """A book for each supplier and return flag, a chapter for each quantity."""
    t = _triples(spark, sf_dir)
    books = B.rebuilt(t.withColumns({"grade": F.concat("target", "grade"), "chapter": F.concat(F.lit("q"), F.col("l_quantity").cast("int"))}).drop("l_quantity"))
    c = books.select("grade", F.explode("chapters").alias("c")).select("grade", F.col("c.chapter").alias("chapter"), F.explode("c.subtopics").alias("s"))
    concept = lambda k: F.concat(k["concept"], F.lit(":"), F.array_join(F.transform(k["relations"], lambda r: F.concat(r["type"], F.lit(">"), r["target"])), ","))
    return c.select("grade", "chapter", F.col("s.subtopic").alias("subtopic"), F.array_join(F.transform("s.concepts", concept), ";").alias("concepts"))


_DUMP = """d as (select case when l_linenumber = 7 then '' else l_returnflag end as rel_type, case when l_quantity = 1 then ' ' else 'n' || l_partkey end as source_name, 'g' || (l_partkey % 3) as source_grade,
  'n' || l_suppkey as target_name, 'g' || (l_suppkey % 3) as target_grade, round(1 - l_discount, 2) as confidence, cast(l_orderkey as varchar) as description, case when l_linenumber % 2 = 0 then 'm' end as method from lineitem),
b as (select 'g' || (l_partkey % 3) || chr(31) || 'n' || l_partkey as src, 'g' || (l_suppkey % 3) || chr(31) || 'n' || l_suppkey as dst, 'A' as rel_type, 'old' as method, 0.5::double as confidence from lineitem group by l_partkey, l_suppkey having count(*) > 1)"""


def _dump(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    grade = lambda c: F.concat(F.lit("g"), F.col(c) % 3)
    properties = F.struct(F.col("l_orderkey").cast("string").alias("description"), F.lit(None).cast("string").alias("relation_type"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.when(n % 2 == 0, "m").alias("method"))
    dump = li.select(
        F.when(n == 7, "").otherwise(F.col("l_returnflag")).alias("rel_type"), F.when(F.col("l_quantity") == 1, " ").otherwise(F.concat(F.lit("n"), "l_partkey")).alias("source_name"), grade("l_partkey").alias("source_grade"),
        F.concat(F.lit("n"), "l_suppkey").alias("target_name"), grade("l_suppkey").alias("target_grade"), properties.alias("properties"),
    )
    end = lambda c: F.concat_ws("\x1f", grade(c), F.concat(F.lit("n"), c))
    old = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(end("l_partkey").alias("src"), end("l_suppkey").alias("dst"), F.lit("A").alias("rel_type"), F.lit("old").alias("method"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("description"))
    return old, dump


@query("replay_dump", f"""with {_DUMP}, g as (select source_grade || chr(31) || source_name as src, target_grade || chr(31) || target_name as dst, rel_type, confidence, description, coalesce(method, 'replay') as method from d
  where rel_type <> '' and trim(source_name) <> '' and not (source_name = target_name and source_grade = target_grade)),
w as (select * from (select *, row_number() over (partition by src, dst, rel_type order by confidence desc, description desc, method desc) as k from g) where k = 1)
select coalesce(w.src, b.src) as src, coalesce(w.dst, b.dst) as dst, coalesce(w.rel_type, b.rel_type) as rel_type, coalesce(w.confidence, b.confidence) as confidence, coalesce(w.method, b.method) as method
from b full join w on b.src = w.src and b.dst = w.dst and b.rel_type = w.rel_type""")
def replay_dump(spark, sf_dir):
    old, dump = _dump(spark, sf_dir)
    once, _ = U.replay(old, dump, "replay")
    twice, _ = U.replay(once, dump, "replay")  # changes nothing
    return twice.select("src", "dst", "rel_type", "confidence", "method")


@query("replay_rejects", f"""with {_DUMP} select case when rel_type = '' then 'no relation type' when trim(source_name) = '' then 'no source' else 'self loop' end as reason, count(*) as n from d
where rel_type = '' or trim(source_name) = '' or source_name = target_name and source_grade = target_grade group by 1""")
def replay_rejects(spark, sf_dir):
    _, rejected = U.replay(*_dump(spark, sf_dir), "replay")
    return M.counts_by(rejected, "reason")


@query("scope_modes", f"""with {_SCORED}, t as (select * from (select *, row_number() over (partition by source order by score desc, target) as rank from s) where rank <= 10 and score >= 0.62),
m(scope) as (values ('all'), ('single'), ('cross'), ('cross_all')),
p as (select distinct scope, least(source, target) as a, greatest(source, target) as b from t, m where scope = 'all' or scope = 'single' and source_grade = '3' and target_grade = '3'
  or scope = 'cross_all' and source_grade <> target_grade or scope = 'cross' and source_grade <> target_grade and '3' in (source_grade, target_grade))
select m.scope, count(p.a) as n from m left join p on p.scope = m.scope group by 1""")
def scope_modes(spark, sf_dir):
    top, grades, out = cut(_top(spark, sf_dir)), _grades(spark, sf_dir), None
    for scope in C.SCOPES:
        rows = C.candidate_pairs(top, grades, 0.62, scope, "3").agg(F.count(F.lit(1)).alias("n")).select(F.lit(scope).alias("scope"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


_KIND = "case l_linenumber when 1 then 'SIMILAR_TO' when 2 then 'isPrerequisiteOf' when 3 then 'supports' when 4 then 'analogousTo' when 5 then 'MENYEBABKAN' when 6 then 'BAGIAN_DARI' else 'HAS_CONCEPT' end"


@query("graph_counters", f"""select (select count(*) from region) as subjects, (select count(*) from nation) as documents, (select count(*) from supplier) as babs, (select count(*) from customer) as sub_babs, (select count(*) from part) as konsep, (select count(*) from orders) as sub_konsep,
(select count(*) from part) as topics, (select count(*) from orders) as subtopics, count(*) filter (k = 'SIMILAR_TO') as similar_rels, count(*) filter (k = 'isPrerequisiteOf') as prereq_rels, count(*) filter (k = 'supports') as supports_rels,
count(*) filter (k = 'analogousTo') as analogous_rels, count(*) filter (k in ('MENYEBABKAN', 'BAGIAN_DARI')) as inline_rels from (select {_KIND} as k from lineitem)""")
def graph_counters(spark, sf_dir):
    labels = {"region": "MataPelajaran", "nation": "Document", "supplier": "Bab", "customer": "SubBab", "part": "Konsep", "orders": "SubKonsep"}
    nodes = None
    for name, label in labels.items():
        rows = table(spark, sf_dir, name).select(F.lit(label).alias("label"))
        nodes = rows if nodes is None else nodes.union(rows)
    kinds = ["SIMILAR_TO", "isPrerequisiteOf", "supports", "analogousTo", "MENYEBABKAN", "BAGIAN_DARI"]
    edges = table(spark, sf_dir, "lineitem").select(F.coalesce(F.get(F.array(*map(F.lit, kinds)), F.col("l_linenumber") - 1), F.lit("HAS_CONCEPT")).alias("rel_type"))
    return M.graph_counters(nodes, edges)


_LISTED = """n as (select 'p' || p_partkey as id, case when p_size % 4 = 0 then 'Chapter' else 'Concept' end as label, p_name as name, case when p_size % 3 > 0 then p_type end as description, case p_size % 5 when 0 then null when 1 then ' ' else p_brand end as ref, p_size % 2 = 0 as ok from part)"""


@query("quality_listings", f"""with {_LISTED}, x as (select 'no_subject_matter' as list, id, name from n where label = 'Concept' and nullif(trim(ref), '') is null union all select 'validated', id, name from n where label = 'Concept' and ok
  union all select 'summarised', id, name from n where label = 'Chapter' and description is not null)
select list, id, name from (select *, row_number() over (partition by list order by name, id) as r from x) where r <= 50""")
def quality_listings(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    nodes = p.select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(size % 4 == 0, "Chapter").otherwise("Concept").alias("label"), F.col("p_name").alias("name"), F.when(size % 3 > 0, F.col("p_type")).alias("description"),
        F.when(size % 5 == 0, None).when(size % 5 == 1, " ").otherwise(F.col("p_brand")).alias("materi_pokok_ref"), (size % 2 == 0).alias("glossary_validated"),
    )
    out = None
    for which in ("no_subject_matter", "validated", "summarised"):
        rows = M.listing(nodes, which).select(F.lit(which).alias("list"), "id", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("provenance_counts", "select l_returnflag as grade, count(*) as n from lineitem where l_linenumber not in (2, 3) group by 1")
def provenance_counts(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grade"), F.when(n == 2, "toc-gap-completion").when(n == 3, "expert-proposed").when(n > 4, "extraction").alias("provenance"))
    return M.counts_by(M.by_provenance(rows, "extraction"), "grade")


@query("vocabulary_dispatch", """select l_returnflag as schema, case when l_linenumber = 1 then null when l_quantity < 3 then null when l_returnflag = 'A' then case l_linenumber when 2 then 'supports' end else case l_linenumber when 3 then 'LINTAS_BUKU_SAMA_DENGAN' end end as stored, count(*) as n from lineitem where l_returnflag <> 'R' group by 1, 2""")
def vocabulary_dispatch(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "none").when(n == 2, "supports").when(n == 3, "SAMA_DENGAN").otherwise("other")
    rows, out = table(spark, sf_dir, "lineitem").select("l_returnflag", kind.alias("kind"), F.when(F.col("l_quantity") >= 3, 1 - F.col("l_discount")).alias("confidence")), None
    for flag, name in (("A", "a"), ("N", "b")):
        _, _, stored = L.for_schema(name)
        part = rows.where(F.col("l_returnflag") == flag).select(F.col("l_returnflag").alias("schema"), stored(F.col("kind"), F.col("confidence")).alias("stored"))
        out = part if out is None else out.unionByName(part)
    return M.counts_by(out, "schema", "stored")


@query("run_parameters", r"""with x as (select p_partkey, 'temperature=0.' || p_size || ', top_k: ' || p_size || '; _top_k=3 model = "' || replace(p_brand, '#', '-') || '"' || case when p_size % 2 = 0 then ' cosine cosine' else '' end as t from part)
select p_partkey, regexp_extract(t, 'temperature\s*[=:]\s*([\d.]+)', 1) as temperature, regexp_extract(t, ', top_k: (\d+)', 1) as top_k, regexp_extract(t, '"([^"]*)"', 1) as model_id, len(regexp_extract_all(t, 'cosine')) as cosine from x""")
def run_parameters(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = F.concat(F.lit("temperature=0."), "p_size", F.lit(", top_k: "), "p_size", F.lit('; _top_k=3 model = "'), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit('"'), F.when(F.col("p_size") % 2 == 0, " cosine cosine").otherwise(""))
    found = p.select("p_partkey", T.scraped(t).alias("f"))
    return found.select("p_partkey", F.col("f")["temperature"][0].alias("temperature"), F.array_join(F.col("f")["top_k"], ",").alias("top_k"), F.get(F.col("f")["model_id"], F.lit(0)).alias("model_id"), F.size(F.col("f")["cosine"]).cast("long").alias("cosine"))
