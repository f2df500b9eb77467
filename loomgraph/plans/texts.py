"""Scalar function queries over names, documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as T

_NORM = "regexp_replace(regexp_replace(upper(trim({0})), '[\\s-]+', '_', 'g'), '[^A-Z0-9_]', '', 'g')"


@query("normalize_rel_type", f"""with t as (select distinct p_type as raw from part union select distinct p_brand || ' -x' from part union select '9 lives' union select '!!' union select '  a-b  c '),
n as (select raw, {_NORM.format('raw')} as t from t), f as (select raw, case when t = '' then 'RELATED_TO' else t end as t from n)
select raw, case when regexp_matches(t, '^[0-9]') then '_' || t else t end as norm, regexp_replace(upper(raw), '[^A-Z0-9_]', '_', 'g') as replaced, replace(replace(upper(raw), ' ', '_'), '-', '_') as spaces from f""")
def normalize_rel_type(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = p.select(F.col("p_type").alias("raw")).union(p.select(F.concat("p_brand", F.lit(" -x")))).union(spark.createDataFrame([("9 lives",), ("!!",), ("  a-b  c ",)], "raw string")).distinct()
    c = F.col("raw")
    return raw.select("raw", T.relation_type(c).alias("norm"), T.relation_type_replacing(c).alias("replaced"), T.relation_type_spaces(c).alias("spaces"))


_RAW = "case l_returnflag when 'A' then ' terdiri_dari ' when 'N' then 'Menghasilkan' when 'R' then case when l_linestatus = 'F' then 'MENYEBABKAN' else 'x' end end"


@query("alias_canonical", f"""with m(raw, canonical) as (values ('TERDIRI_DARI', 'BAGIAN_DARI'), ('MENGHASILKAN', 'MENYEBABKAN'), ('MENYEBABKAN', 'MENYEBABKAN'))
select {_RAW} as raw, any_value(canonical) as canonical, count(*) as n from lineitem left join m on m.raw = upper(trim({_RAW})) group by 1""")
def alias_canonical(spark, sf_dir):
    from ..schemas import WITHIN_BOOK

    f = F.col("l_returnflag")
    raw = F.when(f == "A", " terdiri_dari ").when(f == "N", "Menghasilkan").when(F.col("l_linestatus") == "F", "MENYEBABKAN").otherwise("x")
    return table(spark, sf_dir, "lineitem").groupBy(raw.alias("raw")).agg(F.first(T.canonical_type(raw, WITHIN_BOOK)).alias("canonical"), F.count(F.lit(1)).alias("n"))


@query("parse_variable", """with v as (select p_partkey, replace(p_name, ' ', '_') as n, p_partkey % 4 as k, p_name, p_brand, p_size from part)
select p_partkey, case k when 0 then n when 1 then p_name when 2 then n end as name, case k when 0 then p_brand when 2 then p_brand when 1 then '' end as label, case k when 0 then cast(p_size as varchar) when 3 then null else '' end as unit from v""")
def parse_variable(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    n = F.replace("p_name", F.lit(" "), F.lit("_"))
    t = F.when(k == 0, F.concat(n, F.lit(" ("), "p_brand", F.lit(", "), "p_size", F.lit(")"))).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 2, F.concat(n, F.lit("("), "p_brand", F.lit(")"))).otherwise("  ")
    v = T.variable(t)
    return p.select("p_partkey", v["name"].alias("name"), v["label"].alias("label"), v["unit"].alias("unit"))


@query("clean_text", r"""with a as (select doc_id, regexp_replace(text, '-\s*\n\s*', '', 'g') as t from documents), b as (select doc_id, regexp_replace(t, '[\n\t\r]+', ' ', 'g') as t from a)
select doc_id, length(t) as n_chars, md5(trim(t)) as joined from b""")
def clean_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    for pattern, by in T.CLEANING[:2]:
        d = d.withColumn("text", F.regexp_replace("text", pattern, by))
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.trim("text")).alias("joined"))


_WORD = r"\p{L}\p{M}\p{Nd}_"
#: A number or a run of capitals between other characters; twice, as neighbours share the one between them.
_NUMBER, _CAPITALS = rf"(^|[^{_WORD}])[0-9]{{1,3}}($|[^{_WORD}])", rf"(^|[^{_WORD}])[A-Z]{{2,}}(?:\s+[A-Z]{{2,}}){{0,3}}($|[^{_WORD}])"


@query("clean_text_all_steps", rf"""with a as (select doc_id, regexp_replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), '[\n\t\r]+', ' ', 'g') as t from documents),
b as (select doc_id, regexp_replace(regexp_replace(t, '{_NUMBER}', '\1\2', 'g'), '{_NUMBER}', '\1\2', 'g') as t from a),
c as (select doc_id, regexp_replace(regexp_replace(t, '{_CAPITALS}', '\1\2', 'g'), '{_CAPITALS}', '\1\2', 'g') as t from b),
d as (select doc_id, regexp_replace(regexp_replace(t, '[^\x20-\x7E\x{{00C0}}-\x{{024F}}\x{{1E00}}-\x{{1EFF}}]', ' ', 'g'), ' {{2,}}', ' ', 'g') as t from c)
select doc_id, md5(trim(t)) as clean from d""")
def clean_text_all_steps(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean"))


@query("name_keys_and_tags", r"""select p_partkey, regexp_replace(lower(trim('  ' || p_name || '   ' || p_type)), '\s+', ' ', 'g') as key, printf('t%03d_k%d', cast(round((p_size / 100.0) * 100) as integer), p_size) as tag, case when p_size % 3 = 0 then '(tidak ada)' when p_size % 3 = 1 then p_name else p_name || ', ' || p_brand end as list from part""")
def name_keys_and_tags(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_size") % 3
    items = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("p_name")).otherwise(F.array("p_name", "p_brand"))
    return p.select("p_partkey", T.name_key(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type")).alias("key"), T.sweep_tag(F.col("p_size") / 100, F.col("p_size")).alias("tag"), T.listing(items).alias("list"))


@query("embed_texts", """select p_partkey, p_name || '. ' || p_type || case when p_size % 2 = 0 then ' Rumus: ' || p_brand || ', x' else '' end as a, p_name || '. ' || p_type || ' Merek: ' || p_brand as b, p_name || ': ' || p_type as colon from part""")
def embed_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    extras = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_brand"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    n, d = F.col("p_name"), F.col("p_type")
    return p.select("p_partkey", T.embed_text(n, d, [("Rumus", extras)]).alias("a"), T.embed_text(n, d, [("Merek", F.col("p_brand"))], "b").alias("b"), T.embed_text(n, d, [], "colon").alias("colon"))


@query("json_prop_extract", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_prop_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json(T.without_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "k bigint")["k"].alias("k"))


@query("page_titles", "select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, len(regexp_extract_all(html, '<a href')) as links from pages")
def page_titles(spark, sf_dir):
    found = T.scraped(F.col("html"), {"link": "(<a href)"})
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.size(found["link"]).alias("links")).withColumn("links", F.col("links").cast("long"))


@query("marker_counts", "select doc_id, cast(len(text) - len(replace(text, 'Licensed', '')) as bigint) // 8 + cast(len(text) - len(replace(text, '***', '')) as bigint) // 3 as n from documents")
def marker_counts(spark, sf_dir):
    from ..operators.compare import markers

    return table(spark, sf_dir, "documents").select("doc_id", markers(F.col("text"), ("Licensed", "***")).alias("n"))


@query("model_dimensions", """select distinct p_brand, case when p_size % 3 = 0 then 1536 when p_size % 3 = 1 then 1024 else 768 end as dim from part""")
def model_dimensions(spark, sf_dir):
    k = F.col("p_size") % 3
    name = F.when(k == 0, "Text-Embedding-3-Small").when(k == 1, "BAAI/BGE-Large-en").otherwise("other")
    return table(spark, sf_dir, "part").select("p_brand", T.model_dimension(name).alias("dim")).distinct()


@query("term_matches", """with t as (select distinct split_part(p_name, ' ', 1) as term from part), n as (select distinct p_name as name from part)
select term, min(name) as name, 'part' as how from t join n on contains(lower(name), lower(term)) where len(name) = (select min(len(x.name)) from n x where contains(lower(x.name), lower(term))) group by 1""")
def term_matches(spark, sf_dir):
    from ..operators.context import match_terms

    p = table(spark, sf_dir, "part")
    return match_terms(p.select(F.split("p_name", " ")[0].alias("term")).distinct(), p.select(F.col("p_name").alias("name")).distinct())


@query("term_matches_both_ways", """with t as (select distinct p_name as term from part union select distinct p_type from part union select distinct lower(split_part(p_type, ' ', 1)) || ' ' || p_name from part union select split_part(s_name, '#', 1) || s_suppkey from supplier),
n as (select distinct p_type as name from part union select distinct p_name from part where p_size > 25 union select distinct c_name from customer), x as (select term, lower(term) as k from t), y as (select name, lower(name) as key from n),
m as (select term, name, len(key) as size, k = key as same from x join y on contains(key, k) or contains(k, key)),
r as (select *, row_number() over (partition by term order by same desc, size, name) as r from m)
select term, name, case when name is null then 'none' when same then 'exact' else 'part' end as how from t left join (select * from r where r = 1) using (term)""")
def term_matches_both_ways(spark, sf_dir):
    """All part names, types and their joins, and suppliers, as terms; types, names of large parts and customers as names."""
    from ..operators.context import match_terms

    p, s, c = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer"))
    joined = F.concat_ws(" ", F.lower(F.split("p_type", " ")[0]), "p_name")
    terms = p.select(F.explode(F.array("p_name", "p_type", joined)).alias("term")).union(s.select(F.concat(F.split("s_name", "#")[0], "s_suppkey"))).distinct()
    names = p.select(F.col("p_type").alias("name")).union(p.where("p_size > 25").select("p_name")).union(c.select("c_name")).distinct()
    return match_terms(terms, names)
