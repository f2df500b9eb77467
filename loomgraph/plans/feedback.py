"""Rating queries. Events are ratings (type -> rating), users reviewers; quality and toxic of labels are two raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import feedback as R
from ..operators import metrics as M
from ..streaming import ratings as S

_R = """r as (select event_id, user_id as reviewer, cast(ts as date) as day, event_id // 5 as item,
  case event_type when 'click' then 'correct' when 'view' then 'partial' when 'purchase' then 'correct' when 'signup' then 'missing' when 'error' then 'wrong' else 'partial' end as rating from events)"""
_W = "case rating when 'correct' then 1.0 when 'partial' then 0.5 else 0.0 end"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for kv in S.RATING_OF.items() for x in kv])
    return e.select("event_id", F.col("user_id").alias("reviewer"), F.to_date("ts").alias("day"), F.floor(F.col("event_id") / 5).alias("item"), F.coalesce(kinds[F.col("event_type")], F.lit("partial")).alias("rating"))


@query("rating_pivot", f"""with {_R} select reviewer, count(*) filter (rating = 'correct') as correct, count(*) filter (rating = 'partial') as partial, count(*) filter (rating = 'wrong') as wrong,
count(*) filter (rating = 'missing') as missing, count(*) as total from r group by 1""")
def rating_pivot(spark, sf_dir):
    return R.distribution(ratings(spark, sf_dir), "reviewer")


@query("active_reviewers", f"with {_R}, a as (select reviewer from r where reviewer not in (1, 2) group by 1 having count(*) >= 60) select reviewer, count(*) as n from r semi join a using (reviewer) group by 1")
def active_reviewers(spark, sf_dir):
    return R.active(ratings(spark, sf_dir), (1, 2), 60).groupBy("reviewer").agg(F.count(F.lit(1)).alias("n"))


_PR = f"count(*) filter (rating <> 'missing') as n, count(*) filter (rating = 'missing') as missing, sum({_W}) / nullif(count(*) filter (rating <> 'missing'), 0) as precision, sum({_W}) / nullif(count(*), 0) as recall"


@query("precision_recall", f"with {_R} select reviewer, {_PR} from r group by 1")
def precision_recall(spark, sf_dir):
    return R.precision_recall(ratings(spark, sf_dir), "reviewer")


@query("precision_by_subject", f"with {_R} select item % 3 as subject, {_PR} from r group by 1")
def precision_by_subject(spark, sf_dir):
    return R.precision_recall(ratings(spark, sf_dir).withColumn("subject", F.col("item") % 3), "subject")


@query("precision_rollup", f"with {_R} select item, count(*) as n, avg({_W}) as precision from r where rating <> 'missing' group by rollup (item)")
def precision_rollup(spark, sf_dir):
    return R.precision_rollup(ratings(spark, sf_dir), "item")


@query("consensus_action", f"""with {_R}, v as (select item, day, rating, count(*) as votes from r group by 1, 2, 3),
x as (select *, row_number() over (partition by item, day order by votes desc, list_position(['correct', 'partial', 'wrong', 'missing'], rating)) as k, sum(votes) over (partition by item, day) as n from v)
select item, day, rating as consensus, votes, cast(n as bigint) as n_reviewers, case rating when 'correct' then 'keep' when 'wrong' then 'drop' else 'annotate' end as action from x where k = 1""")
def consensus_action(spark, sf_dir):
    return R.consensus(ratings(spark, sf_dir), "item", "day")


@query("cohen_kappa", """with n as (select count(*) as n, count(*) filter (quality = toxic) as same from labels), a as (select quality as k, count(*) as c from labels group by 1), b as (select toxic as k, count(*) as c from labels group by 1),
e as (select sum(a.c * b.c) as x from a join b using (k)) select n, same / n as agreement, case when x / (n * n) = 1 then 1.0 else (same / n - x / (n * n)) / (1 - x / (n * n)) end as kappa from n, e""")
def cohen_kappa(spark, sf_dir):
    return R.cohen_kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("rating_a"), F.col("toxic").alias("rating_b")))


_TWO = "t as (select doc_id as item, 1 as reviewer, quality as rating from labels union all select doc_id, 2, toxic from labels where quality = 1)"


def _two(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    a = l.select(F.col("doc_id").alias("item"), F.lit(1).alias("reviewer"), F.col("quality").alias("rating"))
    return a.unionByName(l.where("quality = 1").select(F.col("doc_id").alias("item"), F.lit(2).alias("reviewer"), F.col("toxic").alias("rating")))


@query("agreement_list", f"with {_TWO} select item, count(distinct reviewer) as n_reviewers, case when count(distinct reviewer) = 1 then 'single' when min(rating) = max(rating) then 'agreed' else 'disagreed' end as status from t group by 1")
def agreement_list(spark, sf_dir):
    return R.agreement(_two(spark, sf_dir), "item")


@query("reviewer_pairs", f"with {_TWO} select a.reviewer as a, b.reviewer as b, a.rating as rating_a, b.rating as rating_b, count(*) as n from t a join t b using (item) where a.reviewer < b.reviewer group by 1, 2, 3, 4")
def reviewer_pairs(spark, sf_dir):
    return R.reviewer_pairs(_two(spark, sf_dir), "item").groupBy("a", "b", "rating_a", "rating_b").agg(F.count(F.lit(1)).alias("n"))


@query("missing_by_chapter", "select coalesce(nullif(trim(case when event_id % 7 = 0 then '  ' when event_id % 7 = 1 then null else 'Bab ' || (event_id % 7) end), ''), '(no chapter)') as chapter, count(*) as n from events where event_type = 'signup' group by 1")
def missing_by_chapter(spark, sf_dir):
    k = F.col("event_id") % 7
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return R.missing_by_chapter(e.select(F.when(k == 0, "  ").when(k == 1, None).otherwise(F.concat(F.lit("Bab "), k)).alias("chapter")))


@query("sweep_quality", """with s as (select l_orderkey as id, cast(t as double) as threshold, k from lineitem, (values (0.92, 3), (0.95, 5), (0.98, 7)) g(t, k) where round(1 - l_discount, 2) >= t and l_linenumber <= k),
a as (select o_orderkey as id, case when o_orderstatus = 'P' then null when o_orderstatus = 'F' then 'Ya' else 'Tidak' end as valid, case when o_totalprice > 100000 then 'Benar' else 'Salah' end as type_ok, case when o_custkey % 3 = 0 then 'NA' when o_custkey % 3 = 1 then 'Benar' else 'Terbalik' end as direction from orders)
select threshold, cast(k as integer) as k, count(*) as survivors, count(valid) as rated, avg(case when valid is null then null when valid = 'Ya' then 1.0 else 0.0 end) as validity,
avg(case when type_ok is null then null when type_ok = 'Benar' then 1.0 else 0.0 end) as type_ok, avg(case when direction is null then null when direction = 'Benar' then 1.0 else 0.0 end) as direction_ok from s left join a using (id) group by 1, 2""")
def sweep_quality(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.round(1 - F.col("l_discount"), 2).alias("c"))
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k).alias("k")) for t, k in ((0.92, 3), (0.95, 5), (0.98, 7))]))
    s = li.select("id", "c", "l_linenumber", grid.alias("g")).select("id", "c", "l_linenumber", "g.*").where("c >= threshold and l_linenumber <= k").drop("c", "l_linenumber")
    o, turn = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3
    a = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderstatus") == "F", "Ya").otherwise("Tidak").alias("valid"),
        F.when(F.col("o_totalprice") > 100000, "Benar").otherwise("Salah").alias("type_ok"), F.when(turn == 0, "NA").when(turn == 1, "Benar").otherwise("Terbalik").alias("direction"),
    )
    return R.sweep_quality(s, a)


@query("fleiss_kappa", f"""with {_R}, c as (select event_id // 5 as item, rating, count(*) as n from r group by 1, 2), i as (select item, sum(n) as k, sum(n * (n - 1)) as agree from c group by 1),
p as (select avg(agree / (k * (k - 1))) as p, sum(k) as total from i), e as (select sum((n / total) ** 2) as pe from (select rating, sum(n) as n from c group by 1), p) select (p - pe) / (1 - pe) as kappa from p, e""")
def fleiss_kappa(spark, sf_dir):
    return M.fleiss_kappa(ratings(spark, sf_dir).select(F.floor(F.col("event_id") / 5).alias("item"), "rating"))


@query("mcnemar", "with x as (select count(*) filter (quality = 1 and toxic = 0) as b, count(*) filter (quality = 0 and toxic = 1) as c from labels) select b, c, case when b + c > 0 then (abs(b - c) - 1) ** 2 / (b + c) end as chi2 from x")
def mcnemar(spark, sf_dir):
    return M.mcnemar(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("x"), (F.col("toxic") == 1).alias("y")), "x", "y")


@query("likert_by_group", "select event_type as grp, avg(value) as mean, stddev_samp(value) as sd from events group by 1")
def likert_by_group(spark, sf_dir):
    return M.likert(table(spark, sf_dir, "events").withColumnRenamed("event_type", "grp"), "value", "grp")


@query("windowed_ratings", f"with {_R} select day as start, rating, count(distinct event_id) as n from r group by 1, 2")
def windowed_ratings(spark, sf_dir):
    return S.windowed_counts(S.rated(table(spark, sf_dir, "events"))).withColumn("start", F.to_date("start"))
