"""The opN_ queries over the whole intended tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, decontaminate, lines, minhash, pages, phrases, privacy, quality, sharding, tokenbin, whitening, wordpiece

#: Words, five-word shingles, links at 0.75 and smallest reachable doc_id, spelt out.
OP1 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) end as sh
  from w),
e as materialized (select doc_id, len(sh) as n, unnest(sh) as x from s),
inter as (
  select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb
  from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
link as materialized (select a, b from inter where 100 * k >= 75 * (na + nb - k)),
reach(doc_id, r) as (
  select distinct a, a from link union select l.a, reach.r from link l join reach on l.b = reach.doc_id)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, coalesce(m.c, s.doc_id) as component_id, coalesce(m.c, s.doc_id) = s.doc_id as kept
from s left join (select doc_id, min(r) as c from reach group by 1) m on m.doc_id = s.doc_id
"""

#: Every run of whole lines that reaches 50 words at its last or at its first line; all places of a run but the first one go. No fingerprints.
OP3 = r"""
with d as (select distinct doc_id, text from documents where text is not null),
raw as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from (select doc_id, string_split(text, chr(10)) as ls from d)),
l0 as (select doc_id, pos, md5(line) as key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from raw where regexp_matches(line, '[^\x20\x09-\x0D]')),
l1 as materialized (select *, row_number() over w as i, cast(sum(words) over w as bigint) as upto, cast(sum(words) over w as bigint) - words as off
       from l0 window w as (partition by doc_id order by pos)),
ahead as (select doc_id, i as a, max(i) over g as b, max(upto) over g - off as n, list(key) over g as run
          from l1 window g as (partition by doc_id order by off range between current row and 49 following)),
behind as (select doc_id, min(i) over g as a, i as b, upto - min(off) over g as n, list(key) over g as run
           from l1 window g as (partition by doc_id order by upto range between 49 preceding and current row)),
runs as materialized (select doc_id, a, b, md5(array_to_string(run, '')) as run from (from ahead union all from behind) where n >= 50),
firsts as (select run, min(row(doc_id, a)) as f from runs group by 1),
gone as (select distinct r.doc_id, l.pos from runs r join firsts using (run) join l1 l on l.doc_id = r.doc_id and l.i between r.a and r.b where row(r.doc_id, r.a) <> f),
kept as (select r.doc_id, count(*) as n_lines, count(g.pos) as n_removed, coalesce(string_agg(line, chr(10) order by r.pos) filter (g.pos is null), '') as text
         from raw r left join gone g on r.doc_id = g.doc_id and r.pos = g.pos group by 1)
select x.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(length(k.text), 0) as n_chars, md5(coalesce(k.text, '')) as kept_md5
from documents x left join kept k on k.doc_id = x.doc_id
"""

#: All pairs of queries and rows.
OP7 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.v, b.v) as bigint) as score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

#: Equal words at one offset; ten of them within thirteen positions, or a short item whole.
OP8 = r"""
with d as (
  select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents)),
b as (
  select item_id, len(ws) as n, unnest(ws) as w, generate_subscripts(ws, 1) as p from (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from benchmark)),
x as (select doc_id, p, case when trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~') = '' then w else trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~') end as w from d),
y as (select item_id, n, p, case when trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~') = '' then w else trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~') end as w from b),
eq as (select doc_id, item_id, n, x.p - y.p as diag, y.p as p from x join y using (w)),
k as (select doc_id, item_id, n, count(*) over (partition by doc_id, item_id, diag order by p range between current row and 12 following) as c from eq),
hit as (select distinct doc_id, item_id from k where (n >= 10 and c >= 10) or (n between 5 and 9 and c = n)),
g as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by item_id) as item_ids from hit group by 1)
select doc_id, g.n_items is not null as contaminated, g.n_items is null as kept, coalesce(n_items, 0) as n_items, coalesce(item_ids, '') as item_ids
from documents left join g using (doc_id)
"""

#: All phrases of two and three words by text, in 128-bit whole numbers.
OP12 = r"""
with p as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as ws from documents where text is not null),
f as materialized (
  select lang, w, len(w) as k, count(*) as f from (
    select lang, unnest(list_concat(
      [ws[i:i] for i in range(1, len(ws) + 1)], [ws[i:i + 1] for i in range(1, len(ws))], [ws[i:i + 2] for i in range(1, len(ws) - 1)])) as w from p)
  group by 1, 2),
t as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by 1),
c as (select lang, w, k, f as a from f where k > 1 and f >= 10),
cuts as (select *, unnest(range(1, k)) as cut from c),
s as (
  select cuts.*, x.f as l, y.f as r, cast((1000000::hugeint * a * a) // (x.f::hugeint * y.f) as bigint) as score
  from cuts join f x on x.lang = cuts.lang and x.w = cuts.w[1:cut] join f y on y.lang = cuts.lang and y.w = cuts.w[cut + 1:cuts.k]),
b as (select lang, w, k, a, arg_min(struct_pack(l := l, r := r, score := score), score * 2 + cut - 1) as best from s group by 1, 2, 3, 4),
gone as (
  select distinct b.lang, b.w from b join (
    select lang, unnest([w[1:2], w[2:3]]) as w, a from c where k = 3) g on g.lang = b.lang and g.w = b.w and 100 * g.a >= 50 * b.a),
kept as (select b.lang, array_to_string(b.w, ' ') as phrase, a, best.l as l, best.r as r, best.score as score from b anti join gone on gone.lang = b.lang and gone.w = b.w),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join t using (lang) where rank <= 2000
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = covertree.integers(_table(spark, sf_dir, "embeddings"))
    return covertree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flags(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_privacy": op2_privacy,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_top_k": op7_top_k,
    "op8_decontaminate": op8_decontaminate,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_main_text": op10_main_text,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_token_files": op13_token_files,
}
ORACLES: dict[str, str] = {"op1_near_duplicates": OP1, "op3_line_dedup": OP3, "op7_top_k": OP7, "op8_decontaminate": OP8, "op12_collocations": OP12}
