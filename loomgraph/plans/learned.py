"""Queries of what is learned from the tables: pair types, text vectors, terms; and scans of sorted segments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions.text import STOPWORDS
from ..operators import pair_classifier as C
from ..operators import similarity as S
from ..operators import terms as T
from ..operators import text_embedder as E
from ..operators.tables import cut, shared_dir
from ..sources import segments

#: Pair types from the least to the closest.
TYPES = ("none", "BERKAITAN_DENGAN", "MEMPERDALAM", "SAMA_DENGAN")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of neighbouring lines of an order, their features, and as label how many of type and the two words of the name agree; a third is held out."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    pairs = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ka"), after.alias("kb")).where("kb is not null")
    side = lambda c: p.select(F.col("p_partkey").alias(f"k{c}"), C.key(F.concat_ws(" ", "p_type", "p_name")).alias(f"key_{c}"), F.col("p_brand").alias(f"brand_{c}"), F.col("p_type").alias(f"type_{c}"), F.split("p_name", " ").alias(f"name_{c}"), F.col("p_retailprice").alias(f"price_{c}"))
    rows = pairs.join(side("a"), "ka").join(side("b"), "kb")
    near = 1 / (1 + F.abs(F.col("price_a") - F.col("price_b")) / 100)
    same = [F.col("type_a") == F.col("type_b"), *(F.get("name_a", F.lit(k)) == F.get("name_b", F.lit(k)) for k in range(2))]
    agree = sum((F.coalesce(c, F.lit(False)).cast("int") for c in same), F.lit(0))
    label = F.element_at(F.array(*[F.lit(t) for t in TYPES]), agree + 1)
    x = C.features(F.col("key_a"), F.col("key_b"), near, F.col("brand_a"), F.col("brand_b"), keyed=True)
    held = F.crc32(F.concat_ws(":", "l_orderkey", "l_linenumber")) % 3 == 1
    return rows.select("l_orderkey", "l_linenumber", x.alias("x"), label.alias("label"), held.alias("held_out"))


@query("pair_types")
def pair_types(spark, sf_dir):
    pairs = cut(part_pairs(spark, sf_dir))
    model = C.fit(pairs.where("not held_out"), TYPES)
    return model.classified(pairs, F.col("x")).select("l_orderkey", "l_linenumber", "held_out", "label", "rel_type", "confidence")


@query("text_neighbours")
def text_neighbours(spark, sf_dir):
    d = cut(E.counted(table(spark, sf_dir, "documents"), "doc_id"))
    vectors = cut(S.vectors(E.embedded_counted(d, E.fit_counted(d, 32, passes=4)), "id", "vector"))
    return S.neighbours(None, S.index_of(vectors), 3)


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query("extracted_terms", f"""with s as (select list_filter(string_split_regex(unnest(string_split_regex(lower(coalesce(text, '')), '[.,;:!?()\\x0A-\\x0D]+')), '[\\x20\\x09]+'), lambda w: w <> '') as w from documents),
p as (select unnest(list_concat([array_to_string(w[i:i + 1], ' ') for i in range(1, len(w))], [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)], [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])) as phrase from s where len(w) >= 2),
c as materialized (select phrase, string_split(phrase, ' ') as ws, count(*) as n from p where string_split(phrase, ' ')[1] not in ({_STOP}) and string_split(phrase, ' ')[-1] not in ({_STOP}) group by 1 having count(*) >= 10),
i as (select distinct phrase as longer, n as m, unnest(list_concat(case when len(ws) > 2 then [array_to_string(ws[j:j + 1], ' ') for j in range(1, len(ws))] else [] end, case when len(ws) > 3 then [array_to_string(ws[j:j + 2], ' ') for j in range(1, len(ws) - 1)] else [] end)) as phrase from c),
h as (select phrase, count(*) as nested, avg(m) as held from i group by 1),
v as (select c.phrase, cast(len(ws) as integer) as words, n, coalesce(nested, 0) as nested, log2(len(ws)) * (n - coalesce(held, 0)) as c_value from c left join h using (phrase))
select * from v where c_value > 0""")
def extracted_terms(spark, sf_dir):
    return T.extracted_terms(table(spark, sf_dir, "documents"))


@query("scan_progress", """select 'progress:' || user_id || ':' || event_id as key, props as value from events where starts_with('progress:' || user_id || ':' || event_id, 'progress:1')""")
def scan_progress(spark, sf_dir):
    e, path = table(spark, sf_dir, "events"), f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"
    segments.write_segments(e.select(F.concat_ws(":", F.lit("progress"), "user_id", "event_id").alias("key"), F.col("props").alias("value")), path, 64)
    return segments.scan_prefix(spark, path, "progress:1")
