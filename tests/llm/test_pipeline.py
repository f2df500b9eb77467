"""The pipeline against independent versions of its stages: DuckDB SQL for lines, copies and leaks, the public library for tokens."""

import hashlib

import corpus_pipeline
import duckdb
import pytest
import public_tokenizers
import tiktoken

import __spark_entry__ as entry
from loomgraph.llm import queries
from loomgraph.llm.bpe import Ranks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_five_and_in_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    assert corpus_pipeline.ORACLE_SQL is None and entry.queries()["pipeline"] is corpus_pipeline.run


def test_run_equals_the_stages_by_other_means(spark, sf_dir):
    good = {r.doc_id for r in queries.op4_quality(spark, sf_dir).collect() if r.predicted == 1}
    con = duckdb.connect()
    con.execute(f"create table benchmark as select * from '{sf_dir}/benchmark.parquet'")
    con.execute(f"create table documents as select * from '{sf_dir}/documents.parquet'")
    con.execute("create table good as select unnest(?::bigint[]) as doc_id", [sorted(good)])
    con.execute("delete from documents where doc_id not in (select doc_id from good)")
    # line dedup: the oracle's kept texts; documents that lost everything go
    head, _, _ = queries.OP3.rpartition("select x.doc_id")
    con.execute(f"create table lines as {head} select doc_id, n_removed, text from kept")
    con.execute("delete from documents where doc_id in (select doc_id from lines where n_removed > 0 and not regexp_matches(text, '[^\\x20\\x09-\\x0D]'))")
    con.execute("update documents set text = l.text, n_chars = length(l.text) from lines l where l.doc_id = documents.doc_id and l.n_removed > 0")
    con.execute(f"delete from documents where doc_id in (select doc_id from ({queries.OP1}) where not kept)")
    con.execute(f"delete from documents where doc_id in (select doc_id from ({queries.OP8}) where contaminated)")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Ranks(f.read()).encoder, special_tokens={})
    want = {}
    for doc, text in con.execute("select doc_id, text from documents").fetchall():
        ids = own.encode_ordinary(text or "")
        want[doc] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_each_stage_keeps_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert 0 < docs.count() <= 60


def test_a_run_goes_on_after_the_last_complete_stage(spark, sf_dir, tmp_path, monkeypatch):
    ran, frames = [], {}

    def stage(k):
        def run(spark, docs, sf_dir):
            ran.append(k)
            if k == 2 and ran.count(2) == 1:
                raise RuntimeError("lost")
            return docs.where(f"doc_id % {k + 2} <> 0")

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), stage(k)) for k in range(4)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf_dir, str(tmp_path))
    frames = corpus_pipeline.run(spark, sf_dir, str(tmp_path))
    assert ran == [0, 1, 2, 2, 3]
    assert frames.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 <> 0 and doc_id % 3 <> 0 and doc_id % 4 <> 0 and doc_id % 5 <> 0").count()


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t", "en", None, 5), (None, "four little words here", None, "s", None), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "A b C d E f " * 9000, "de", "s", 108000), (None, None, None, None, None)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 0, 0), (2, None, 1), (None, 1, 1), (6, 1, 0)] if rows else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, None), (None, "too short"), (2, "a b c d e f a b c d e f")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[1:-1]:  # the classifier has nothing to learn from; it is tested with its operator
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        left[name] = sorted(map(str, (r.doc_id for r in out.collect())))
        docs = spark.createDataFrame(out.collect(), docs.schema)
    if not rows:
        assert all(v == [] for v in left.values()) and corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        return
    assert left["line dedup"] == ["1", "2", "3", "4", "4", "5", "None", "None"] == left["MinHash near-dedup"]
    assert left["benchmark decontamination"] == ["1", "2", "3", "4", "4", "None", "None"]
    got = corpus_pipeline.token_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got)[:3] == [("1", 0), ("2", 0), ("3", got[[g.doc_id for g in got].index(3)].n_tokens)]
