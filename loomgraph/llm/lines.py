"""Line deduplication by winnowing over line hashes, with DataFrame operations only.

Lines that are not blank are numbered in each document and placed at their word offset. A
gram is the shortest run of whole lines from a line on that has ``GRAM`` words; of all
grams that start within ``WINDOW`` words, the one with the least hash is a fingerprint. So
any repeated run of ``GRAM + WINDOW - 1`` words (49) shares a fingerprint, wherever it stands.

Each least run of whole lines of ``RUN`` words, from a line on or up to one, holds a fingerprint that its
words alone decide. Of the runs whose fingerprint stands in two places or more, partial aggregation finds the first
place of each run in (doc_id, text, line) order; its lines are deleted at every later place. So a run is
compared with all holders of the same run, not with one holder of its fingerprint, and any repeated run of ``RUN``
words or more, a union of least runs, is deleted but for its first place.

Groups of any size: a run that a third of all documents share costs a row for each document, never a pair of
documents; overlapping runs of a document are merged in one pass.

Null and empty texts have no lines and come back as they are. Rows with the same doc_id and
text are one document and lose the same lines; rows with the same doc_id and other
texts are documents of their own, as are null doc_ids. Blank lines stay. Words are what white space (space, U+0009 to U+000D)
separates. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut

GRAM, WINDOW, RUN = 25, 25, 50
#: First places of runs, of 100 bytes each, that are broadcast.
BROADCAST_RUNS = 250_000
_DOC = ("doc_id", "text_key")
_NOT_BLANK = r"[^\x20\x09-\x0D]"


def _text_key():
    return F.xxhash64("text")


def _hash(keys: str):
    return F.unhex(F.md5(F.array_join(F.transform(keys, F.hex), "")))


def _runs(df: DataFrame) -> DataFrame:
    """Least runs of whole lines of ``RUN`` words, from each line on and up to each: doc key, start and stop (positions
    in the text), run (hash of the lines), gram (the fingerprint inside) and mark (its position)."""
    docs = df.select("doc_id", "text").where("text is not null").select("doc_id", _text_key().alias("text_key"), "text")
    lines = docs.select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(_NOT_BLANK))
    lines = lines.select(
        *_DOC, "pos", F.unhex(F.md5("line")).alias("key"),
        F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    lines = lines.groupBy(*_DOC, "pos").agg(F.first("key").alias("key"), F.first("words").alias("words"))  # repeated rows
    by = Window.partitionBy(*_DOC).orderBy("pos")
    lines = lines.withColumn("end", F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.col("end") - F.col("words"))
    ahead = Window.partitionBy(*_DOC).orderBy("at")
    gram, run = ahead.rangeBetween(0, GRAM - 1), ahead.rangeBetween(0, RUN - 1)
    lines = lines.select("*", F.sum("words").over(gram).alias("covered"), F.collect_list("key").over(gram).alias("keys"))
    lines = lines.withColumn("gram", F.when(F.col("covered") >= GRAM, _hash("keys"))).drop("covered", "keys")
    # each start picks the least gram of its window: the fingerprint of the runs from there on
    lines = lines.withColumn("least", F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", "pos"))).over(ahead.rangeBetween(0, WINDOW - 1))).drop("gram")
    lines = lines.select("*", F.max("end").over(run).alias("to"), F.max("pos").over(run).alias("stop"), F.collect_list("key").over(run).alias("keys"))
    lines = lines.withColumn("on", F.when(F.col("to") - F.col("at") >= RUN, F.struct(F.col("pos").alias("start"), "stop", _hash("keys").alias("run"), "least")))
    lines = lines.drop("to", "stop", "keys")
    behind = Window.partitionBy(*_DOC).orderBy("end").rangeBetween(-(RUN - 1), 0)
    lines = lines.select("*", F.min(F.struct("pos", "at", "least")).over(behind).alias("head"), F.collect_list("key").over(behind).alias("keys"))
    # a run up to a line that reaches RUN words only with that line is the run on from its start
    back = (F.col("end") - F.col("head.at") >= RUN) & (F.col("at") - F.col("head.at") >= RUN)
    lines = lines.withColumn("upto", F.when(back, F.struct(F.col("head.pos").alias("start"), F.col("pos").alias("stop"), _hash("keys").alias("run"), F.col("head.least").alias("least"))))
    runs = lines.select(*_DOC, F.explode(F.array("on", "upto")).alias("r")).where("r is not null")
    return runs.select(*_DOC, "r.start", "r.stop", "r.run", F.col("r.least.gram").alias("gram"), F.col("r.least.pos").alias("mark"))


def _deleted(df: DataFrame) -> DataFrame:
    """doc_id, text_key, gone: the positions to delete (blank ones between them too), of documents that lose some."""
    runs = cut(_runs(df), "runs")
    place = F.struct(*_DOC, "mark")
    prints = runs.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    shared = cut(runs.join(prints.select("gram"), "gram", "left_semi").drop("gram", "mark"), "shared")
    place = F.struct(*_DOC, "start")
    # first places are broadcast where their number allows it, else joined as a table: a run that very many documents hold is then split up
    firsts = cut(shared.groupBy("run").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("run", "first"), "firsts")
    later = shared.join(bounded(firsts, BROADCAST_RUNS), "run").where(~place.eqNullSafe(F.col("first"))).select(*_DOC, "start", "stop")
    before = F.max("stop").over(Window.partitionBy(*_DOC).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.greatest("start", F.coalesce(before + 1, "start"))).where(F.col("new") <= F.col("stop"))
    return later.groupBy(*_DOC).agg(F.flatten(F.collect_list(F.sequence("new", "stop"))).alias("gone"))


def _marked(df: DataFrame) -> DataFrame:
    """row (all columns of ``df`` as they were), text (what is left), n_lines (before) and n_removed."""
    # the rows' own names are kept apart from those of the join
    whole = df.select(F.struct("*").alias("row"), "doc_id", _text_key().alias("text_key"), "text")
    gone = _deleted(df).withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    out = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    split = F.split("text", "\n", -1)
    blank = F.filter(F.transform(split, lambda line, i: F.when(~line.rlike(_NOT_BLANK), i)), lambda i: i.isNotNull())
    out = out.withColumn("gone", F.array_except("gone", blank))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone"), lambda i: F.get(split, i))
    return out.select(
        "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def deduplicate(df: DataFrame) -> DataFrame:
    """``df`` with later repeated runs deleted from ``text``."""
    return _marked(df).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in df.columns])


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and kept_md5 of the text left: one row per row of ``df``."""
    out = _marked(df.select("doc_id", "text"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"),
    )


def without_repeats(df: DataFrame) -> DataFrame:
    """The stage: texts without later repeated runs; documents that lost all their lines go.

    A column n_chars is brought up to date.
    """
    out = _marked(df).where((F.col("n_removed") == 0) | F.col("text").rlike(_NOT_BLANK))
    new = {"text": F.col("text")}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row")["n_chars"]).cast(df.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in df.columns])
