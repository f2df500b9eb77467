"""Merge, compare and context queries over line items as typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as T
from ..operators import books as B
from ..operators import candidates as C
from ..operators import compare as K
from ..operators import context as X
from ..operators import upsert as U
from ..operators.tables import spread
from .structure import edges as all_edges

_E = """e as (select 'p' || l_partkey as src, 's' || l_suppkey as dst, l_returnflag || l_linestatus as rel_type, round(1 - l_discount, 2) as confidence, l_orderkey, l_linenumber, l_shipmode_k, l_shipdate
  from (select *, l_orderkey * 10 + l_linenumber as l_shipmode_k from lineitem))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.concat("l_returnflag", "l_linestatus").alias("rel_type"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_shipdate",
    )


@query("merge_last_wins", f"with {_E}, r as (select *, row_number() over (partition by src, dst, rel_type order by l_shipmode_k desc) as k from e) select src, dst, rel_type, confidence, l_shipmode_k as at from r where k = 1")
def merge_last_wins(spark, sf_dir):
    return C.last_wins(edges(spark, sf_dir), ["src", "dst", "rel_type"], ["at"]).drop("l_shipdate")


@query("merge_first_wins", f"with {_E}, r as (select *, row_number() over (partition by src, dst, rel_type order by l_shipmode_k) as k from e) select src, dst, rel_type, confidence, l_shipmode_k as at from r where k = 1")
def merge_first_wins(spark, sf_dir):
    return C.first_wins(edges(spark, sf_dir), ["src", "dst", "rel_type"], ["at"]).drop("l_shipdate")


@query("upsert_edges", f"""with {_E}, b as (select src, dst, rel_type, max(confidence) as confidence, 'old' as method from e where l_shipdate < timestamp '1996-01-01' group by 1, 2, 3),
c as (select src, dst, rel_type, confidence, case when l_linenumber % 2 = 0 then 'new' end as method from (select *, row_number() over (partition by src, dst, rel_type order by l_shipmode_k desc) as k from e where l_shipdate >= timestamp '1996-01-01') where k = 1)
select coalesce(c.src, b.src) as src, coalesce(c.dst, b.dst) as dst, coalesce(c.rel_type, b.rel_type) as rel_type, coalesce(c.confidence, b.confidence) as confidence, coalesce(c.method, b.method) as method
from b full join c on b.src = c.src and b.dst = c.dst and b.rel_type = c.rel_type""")
def upsert_edges(spark, sf_dir):
    e = edges(spark, sf_dir)
    keys = ["src", "dst", "rel_type"]
    early = F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))
    old = e.where(early).groupBy(*keys).agg(F.max("confidence").alias("confidence")).withColumn("method", F.lit("old"))
    new = e.where(~early).withColumn("method", F.when(F.col("at") % 10 % 2 == 0, "new"))
    return U.upsert(old, new, keys, ["at"])


@query("resolve_or_stub", """select 'p' || l_partkey as src, case when s_suppkey is not null then 's' || l_suppkey else '?' || l_suppkey end as dst, case when s_suppkey is not null then 'Concept' else 'ConceptTarget' end as target_label
from lineitem left join (select * from supplier where s_acctbal > 0) on l_suppkey = s_suppkey""")
def resolve_or_stub(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    rows = B.resolved(li, known, ["l_suppkey"], F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("?"), "l_suppkey"))
    return rows.select(F.concat(F.lit("p"), "l_partkey").alias("src"), "dst", "target_label")


_STAGED = """g as (select case when l_linenumber = 7 then '' when l_linenumber = 6 then '1x' else l_returnflag || '_' || l_linestatus end as rel_type, case when l_quantity = 1 then '  ' else 'n' || l_partkey end as source_name, 'g' || (l_partkey % 3) as source_grade,
  case when l_quantity = 2 then null else 'n' || l_suppkey end as target_name, 'g' || (l_suppkey % 3) as target_grade, round(1 - l_discount, 2) as confidence from lineitem)"""


def _staged(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.when(n == 7, "").when(n == 6, "1x").otherwise(F.concat_ws("_", "l_returnflag", "l_linestatus")).alias("rel_type"), F.when(F.col("l_quantity") == 1, "  ").otherwise(F.concat(F.lit("n"), "l_partkey")).alias("source_name"),
        F.concat(F.lit("g"), F.col("l_partkey") % 3).alias("source_grade"), F.when(F.col("l_quantity") != 2, F.concat(F.lit("n"), "l_suppkey")).alias("target_name"), F.concat(F.lit("g"), F.col("l_suppkey") % 3).alias("target_grade"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )


@query("edge_validation_reasons", f"""with {_STAGED} select case when trim(rel_type) = '' then 'no relation type' when not regexp_matches(rel_type, '^[A-Za-z_][A-Za-z0-9_]*$') then 'bad relation type' when coalesce(trim(source_name), '') = '' then 'no source'
 when coalesce(trim(target_name), '') = '' then 'no target' when source_name = target_name and source_grade = target_grade then 'self loop' end as reason, count(*) as n from g group by 1""")
def edge_validation_reasons(spark, sf_dir):
    return _staged(spark, sf_dir).groupBy(U.edge_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("prediction_reasons", """with g as (select case when l_linenumber = 7 then ' ' when l_linenumber = 6 then 'none' when l_linenumber = 5 then 'OTHER' when l_returnflag = 'A' then 'BERKAITAN_DENGAN' when l_returnflag = 'N' then 'MEMPERDALAM' else 'SAMA_DENGAN' end as t, case when l_quantity = 1 then null else round(1 - l_discount, 2) end as c from lineitem)
select case when trim(t) = '' then 'empty' when upper(t) = 'NONE' then 'none' when t = 'OTHER' then 'bad_type' when coalesce(c, 0) < (case when t = 'BERKAITAN_DENGAN' then 0.96 else 0.93 end) then 'low_conf' when t in ('SAMA_DENGAN', 'BERKAITAN_DENGAN') then 'sym' else 'asym' end as reason, count(*) as n from g group by 1""")
def prediction_reasons(spark, sf_dir):
    from ..schemas import CROSS_BOOK, CROSS_BOOK_SYMMETRIC

    n, f = F.col("l_linenumber"), F.col("l_returnflag")
    t = F.when(n == 7, " ").when(n == 6, "none").when(n == 5, "OTHER").when(f == "A", "BERKAITAN_DENGAN").when(f == "N", "MEMPERDALAM").otherwise("SAMA_DENGAN")
    g = table(spark, sf_dir, "lineitem").select(t.alias("rel_type"), F.when(F.col("l_quantity") != 1, F.round(1 - F.col("l_discount"), 2)).alias("confidence"))
    reason = U.prediction_reason(CROSS_BOOK, CROSS_BOOK_SYMMETRIC, {"BERKAITAN_DENGAN": 0.96}, 0.93)
    return g.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("staged_dump", f"with {_E} select rel_type, count(*) as n, round(avg(confidence), 9) as mean from e where confidence >= 0.95 and rel_type <> 'NO' group by 1")
def staged_dump(spark, sf_dir):
    e = edges(spark, sf_dir).where("confidence >= 0.95").withColumn("rel_type", F.when(F.col("rel_type") == "NO", "none").otherwise(F.col("rel_type")))
    return U.staged(e).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 9).alias("mean"))


@query("selective_delete", f"with {_E} select count(*) as n, count(distinct src) as sources from e where not (rel_type like 'A%') and confidence <> 0.95")
def selective_delete(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("method", F.when(F.col("confidence") == 0.95, "auto"))
    return U.without(e, "auto", "A").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


_HALVES = "h as (select src, dst, rel_type, l_shipdate < timestamp '1995-06-15' as early from e)"


def _halves(spark, sf_dir):
    e = edges(spark, sf_dir)
    early = F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1995-06-15 00:00:00"))
    return e.where(early), e.where(~early)


@query("method_overlap", f"""with {_E}, {_HALVES}, a as (select distinct least(src, dst) as a, greatest(src, dst) as b, rel_type from h where early), b as (select distinct least(src, dst) as a, greatest(src, dst) as b, rel_type from h where not early)
select (select count(*) from (select * from a except select * from b)) as only_first, (select count(*) from (select * from a intersect select * from b)) as both, (select count(*) from (select * from b except select * from a)) as only_second""")
def method_overlap(spark, sf_dir):
    return K.overlap(*_halves(spark, sf_dir), typed=True)


@query("added_removed", f"""with {_E}, {_HALVES}, a as (select distinct src, dst, rel_type from h where early), b as (select distinct src, dst, rel_type from h where not early)
select *, 'added' as change from (select * from b except select * from a) union all select *, 'removed' from (select * from a except select * from b)""")
def added_removed(spark, sf_dir):
    return K.added_removed(*_halves(spark, sf_dir), ["src", "dst", "rel_type"])


@query("set_operations", f"""with {_E}, {_HALVES}, a as (select distinct src from h where early and rel_type = 'RF'), b as (select distinct src from h where not early)
select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b)""")
def set_operations(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    a, b = a.where("rel_type = 'RF'").select("src").distinct(), b.select("src").distinct()
    count = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return count(K.union_distinct([a, b]), "union").unionByName(count(K.intersection(a, b), "intersect"))


@query("source_target_matrix", "select l_returnflag as source, count(*) filter (l_linestatus = 'F') as F, count(*) filter (l_linestatus = 'O') as O from lineitem group by 1")
def source_target_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target"))
    return K.matrix(li, "source", "target", ["F", "O"])


@query("context_top_edges", f"""with {_E}, r as (select src, rel_type, dst, confidence, row_number() over (partition by src order by confidence desc, rel_type, dst, l_shipmode_k) as k from (select src, dst, rel_type, max(confidence) as confidence, min(l_shipmode_k) as l_shipmode_k from e group by 1, 2, 3))
select src, string_agg(rel_type || '>' || dst, ',' order by k) as out_edges from r where k <= 5 group by 1""")
def context_top_edges(spark, sf_dir):
    # spread by source once: the edges, the ranks and the lists of a source stay where they are
    e = spread(edges(spark, sf_dir).select("src", "dst", "rel_type", "confidence"), "src").groupBy("src", "dst", "rel_type").agg(F.max("confidence").alias("confidence"))
    return X.top_edges(e).select("src", F.array_join(F.transform("out_edges", lambda s: F.concat_ws(">", s["rel_type"], s["target"])), ",").alias("out_edges"))


@query("shared_neighbors", """with e as (select distinct o_custkey as src, o_orderpriority || o_orderstatus as dst from orders), p as (select x.c_custkey as a, y.c_custkey as b from customer x join customer y on x.c_nationkey = y.c_nationkey and x.c_mktsegment = y.c_mktsegment and x.c_custkey < y.c_custkey)
select p.a, p.b, coalesce(string_agg(x.dst, ',' order by x.dst) filter (y.dst is not null), '') as shared from p left join e x on x.src = p.a left join e y on y.src = p.b and y.dst = x.dst group by 1, 2""")
def shared_neighbors(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    e = o.select(F.col("o_custkey").alias("src"), F.concat("o_orderpriority", "o_orderstatus").alias("dst"))
    return X.shared_in_groups(c, e, ["c_nationkey", "c_mktsegment"]).select("a", "b", F.array_join("shared", ",").alias("shared"))


@query("token_overlap_links", r"""with d as (select distinct p_brand || ' ' || p_type as id, p_brand as grp, lower(p_brand || ' ' || p_type || ' ' || p_name) as text from part), i as (select id, grp, string_agg(text, ' ') as text from d group by 1, 2),
k as (select id, grp, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda t: len(t) >= 4)) as ts from i),
t as (select id, grp, unnest(ts) as t from k), h as (select x.id as source, y.id as target, count(*) as common from t x join t y using (t) where x.grp <> y.grp group by 1, 2 having count(*) >= 2)
select source, target, common, cast(k as integer) as rank from (select *, row_number() over (partition by source order by common desc, target) as k from h) where k <= 2""")
def token_overlap_links(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("id"), F.col("p_brand").alias("grp"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("text")).distinct()
    return X.token_links(p.groupBy("id", "grp").agg(F.array_join(F.sort_array(F.collect_set("text")), " ").alias("text")))


@query("fingerprint_keys", """select p_partkey, sha256(p_name || chr(31) || 'm1') as key, substr(md5('{"a": {"bab": "' || p_brand || '", "edges": [{"confidence": ' || (p_size / 100)::varchar || ', "rel_type": "T", "target": "' || p_name || '"}]}, "b": {"bab": null, "edges": []}, "shared": ["' || p_type || '", "x"]}'), 1, 12) as print,
'b||' || least(p_name, p_brand) || '||' || greatest(p_name, p_brand) || '||x' as pair from part""")
def fingerprint_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name, brand = F.col("p_name"), F.col("p_brand")
    edges_a = F.array(F.struct(F.lit("T").alias("rel_type"), name.alias("target"), (F.col("p_size") / 100).alias("confidence")))
    none = F.array().cast("array<struct<rel_type:string,target:string,confidence:double>>")
    print_ = T.fingerprint(brand, edges_a, F.lit(None).cast("string"), none, F.array(F.col("p_type"), F.lit("x")))
    return p.select("p_partkey", T.cache_key(name, F.lit("m1")).alias("key"), print_.alias("print"), T.pair_text(name, brand, "b", F.lit("x")).alias("pair"))


@query("survey_split", "select l_returnflag as rel, count(*) filter (round(1 - l_discount, 2) >= 0.95) as shown, count(*) filter (round(1 - l_discount, 2) < 0.95) as held from lineitem group by 1")
def survey_split(spark, sf_dir):
    e = all_edges(spark, sf_dir).withColumn("rel", F.substring("rel_type", 1, 1))
    shown, held = U.survey(e, "seed", 0.95)
    rows = shown.select("rel", F.lit(1).alias("s")).unionByName(held.select("rel", F.lit(0).alias("s")))
    return rows.groupBy("rel").agg(F.sum("s").alias("shown"), F.sum(1 - F.col("s")).alias("held"))
