"""Personal data: base patterns and information-theoretic sanitisation, with DataFrame operations only.

Base spans are found by pattern (``KINDS``), leftmost and not overlapping within a kind, then checked
(number ranges, Luhn, digits); failing ones are dropped and not tried again. No span crosses a
line, so documents that hold any are cut into lines and searched line by line.

The values found are the protected entities; so are ``secret`` spans, which the method adds to the four base kinds: runs of 16 or
more letters and digits that hold at least two of each (keys, tokens, passwords). Contexts are the distinct pieces of lines of all
documents (a line, or its consecutive parts of up to 1,024 characters where it is longer): a copy is no new evidence. For an entity c and a
term t (``TERM``) the corpus gives

    P(c) = n(c)/N      P(c|t) = (n(c,t) + P(c)) / (n(t) + 1)
    IC(c) = -log2 P(c)      PMI(c;t) = log2 P(c|t) / P(c)

and disclosure PMI/IC, the share of c's information that t gives away: near 1 if t stands only next
to c. Every entity and every term beside it is estimated, those seen once too; P(c|t) is shrunk to P(c) by the weight of
one line, so few lines claim a little less than many. Terms that reach ``GENERALISE`` are replaced by a
label of c's kind, and from ``REMOVE`` on removed, in all documents that hold c. An entity in every line has
no information to give away.

The work grows with the text: a context has bounded numbers of entities and of terms, so pairs of both are a bounded number for
each character; pairs are summed up before they meet the counts of their terms, one row a term; and a term's strong pairs, few
because P(c|t) must be large in each, meet documents by the term.

Term counts cover all documents. Contexts that stand in one place only, nearly all of them, are counted where they are; the
repeated ones, known by their hashes, are brought together (all are if more than ``BROADCAST_KEYS`` are repeated).

Null and empty texts have no spans. Very long texts are searched whole, in time proportional
to their length. Rows with the same doc_id and text get the same spans, and count once; rows with the same
or null doc_id and other texts are documents of their own. Extra columns, whatever their names, are ignored by ``report`` and kept by
``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, bounded, cut

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Kind, test that a line must pass, pattern. Possessive loops give up nothing (no later part could use it) and keep Java's
#: stack flat; "at the end of the last match or not after the same kind of character" only skips starts that must fail.
KINDS = (
    ("email", r"@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("secret", r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{16})(?=[A-Za-z]*+[0-9])[0-9]*+[A-Za-z]", r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+"),
)
#: The kinds that base_sha256 covers.
BASE = ("email", "ip", "card", "phone")
#: Consecutive parts of a line that are contexts; no term is cut, but for runs of more letters than this.
CONTEXT = r"[^\n]{1,1024}(?!\p{L})|[^\n]{1,1024}"
#: What may give an entity away: runs of letters.
TERM = r"\p{L}{4,}+"
GENERALISE, REMOVE = 0.75, 0.9
#: Key of a document; a null doc_id is the empty string.
_DOC = ("doc_key", "text_key")


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(_doc_key(), F.xxhash64("text").alias("text_key"), "text")


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key")


def _places(line: Column, pattern: str) -> Column:
    """Matches of a pattern in a line: array of (match, text between the last match and this one)."""
    matches = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(line, pattern, -1), F.lit(1), F.size(matches))
    return F.arrays_zip(matches.alias("found"), between.alias("gap"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, doubled at every second place from the right, add up to a multiple of ten."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(F.filter(places, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    # a part is at most 255 if, without its leading zeros, it is
    small = F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "email", True).when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(12, 19), _luhn(digits)).otherwise(False)).when(kind == "phone", n.between(9, 15))
        .otherwise(value.rlike("[0-9][A-Za-z]*[0-9]") & value.rlike("[A-Za-z][0-9]*[A-Za-z]"))
    )


def _lines(df: DataFrame) -> DataFrame:
    """Lines of the documents that may hold a base span: doc key, line_no, line, at (first code point)."""
    may = F.lit(False)
    for _, test, _ in KINDS:
        may = may | F.col("text").rlike(test)
    docs = _keyed(df).where(may).groupBy(*_DOC).agg(F.first("text").alias("text"))
    lines = docs.select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(*_DOC).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def _base(lines: DataFrame) -> DataFrame:
    """doc key, line_no, kind, start, end, value of the valid base spans."""
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.when(F.col("line").rlike(test), _places(F.col("line"), pattern)).alias("places")) for k, test, pattern in KINDS
    ])
    rows = lines.select(*_DOC, "line_no", "at", F.explode(kinds).alias("k")).select(*_DOC, "line_no", "at", "k.kind", F.posexplode("k.places").alias("n", "p"))
    upto = Window.partitionBy(*_DOC, "line_no", "kind").orderBy("n")
    end = F.col("at") + F.sum(F.length("p.gap") + F.length("p.found")).over(upto)
    rows = rows.select(*_DOC, "line_no", "kind", (end - F.length("p.found")).alias("start"), end.alias("end"), F.col("p.found").alias("value"))
    return rows.where(_valid(F.col("kind"), F.col("value")))


def _pieces(lines: DataFrame) -> DataFrame:
    """The contexts of the lines: doc key, line_no, at (first code point), context (hash), piece."""
    rows = lines.select(*_DOC, "line_no", F.col("at").alias("line_at"), F.posexplode(F.regexp_extract_all("line", F.lit(CONTEXT), F.lit(0))).alias("n", "piece"))
    before = Window.partitionBy(*_DOC, "line_no").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("line_at") + F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    return rows.select(*_DOC, "line_no", at.alias("at"), F.xxhash64("piece").alias("context"), "piece")


def _words(pieces: DataFrame) -> DataFrame:
    """doc key, line_no, context, start, end, term of all terms in the contexts."""
    rows = pieces.select(*_DOC, "line_no", "context", "at", F.posexplode(_places(F.col("piece"), TERM)).alias("n", "p"))
    end = F.col("at") + F.sum(F.length("p.gap") + F.length("p.found")).over(Window.partitionBy(*_DOC, "line_no", "at").orderBy("n"))
    return rows.select(*_DOC, "line_no", "context", (end - F.length("p.found")).alias("start"), end.alias("end"), F.lower("p.found").alias("term"))


def _entity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind == "email", F.lower(value)).when(kind.isin("card", "phone"), _digits(value)).otherwise(value))


def _held(base: DataFrame, pieces: DataFrame) -> DataFrame:
    """context, entity: the distinct contexts in which entities begin."""
    starts = pieces.select(*_DOC, "line_no", "at", F.lit(0).alias("n"), "context", F.lit(None).cast("string").alias("entity"))
    marks = base.select(*_DOC, "line_no", F.col("start").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("context"), _entity(F.col("kind"), F.col("value")).alias("entity"))
    upto = Window.partitionBy(*_DOC, "line_no").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = starts.unionByName(marks).withColumn("context", F.last("context", ignorenulls=True).over(upto))
    return rows.where("entity is not null").select("context", "entity").distinct()


def disclosing(df: DataFrame, base: DataFrame, pieces: DataFrame, words: DataFrame) -> DataFrame:
    """entity, term, disclosure of the terms that reach ``GENERALISE``."""
    held = cut(_held(base, pieces), "held")
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    near = words.join(held.select("context").distinct(), "context", "left_semi").select("context", "term").distinct()
    pairs = held.join(near, "context").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")).join(entities, "entity")
    corpus = df.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(CONTEXT), F.lit(0))).alias("piece")).where(F.col("piece").rlike(r"[^\x20\x09-\x0D]"))
    corpus = corpus.select(F.xxhash64("piece").alias("context"), "piece")
    contexts = cut(corpus.groupBy("context").agg(F.count(F.lit(1)).alias("n")), "contexts")
    total = contexts.count()
    repeated = contexts.where("n > 1").select("context")
    if repeated.count() <= BROADCAST_KEYS:
        again = corpus.join(F.broadcast(repeated), "context", "left_semi").groupBy("context").agg(F.first("piece").alias("piece"))
        once = corpus.join(F.broadcast(repeated), "context", "left_anti").select("piece").union(again.select("piece"))
    else:
        once = corpus.groupBy("context").agg(F.first("piece").alias("piece"))
    terms = F.array_distinct(F.transform(F.regexp_extract_all("piece", F.lit(TERM), F.lit(0)), F.lower))
    counted = once.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    chance = F.col("n_c") / F.lit(float(total))
    shared = F.log2((F.col("n_ct") + chance) / (F.col("n_t") + 1) / chance)
    found = pairs.join(counted, "term").where(F.col("n_c") < total)
    return found.select("entity", "term", F.round(F.try_divide(shared, -F.log2(chance)), 9).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def find(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, lines): spans have doc key, line_no, kind, start, end and label, what the span becomes."""
    lines = cut(_lines(df), "lines")
    base = cut(_base(lines), "base")
    lines = cut(lines.join(base.select(*_DOC).distinct(), [*_DOC], "left_semi"), "lines")
    pieces = cut(_pieces(lines), "pieces")
    words = cut(_words(pieces), "words")
    strong = cut(disclosing(df, base, pieces, words), "disclosing")
    spans = base.select(*_DOC, "line_no", "kind", "start", "end", F.concat(F.lit("["), F.upper("kind"), F.lit("]")).alias("label"))
    if not strong.isEmpty():
        # broadcast where their number allows it, else joined as tables: a term that stands everywhere is then split up
        terms = cut(strong.select("term").distinct(), "strong-terms")
        words = cut(words.join(bounded(terms), "term", "left_semi"), "strong-words")
        owners = base.select(*_DOC, _entity(F.col("kind"), F.col("value")).alias("entity")).distinct()
        # the strongest claim on a term, of the entities of its document, decides
        owned = cut(words.select(*_DOC, "term").distinct(), "strong-places").join(bounded(strong, BROADCAST_KEYS // 4), "term").join(owners, [*_DOC, "entity"], "left_semi")
        owned = owned.groupBy(*_DOC, "term").agg(F.max(F.struct("disclosure", "entity")).alias("by"))
        label = F.when(F.col("by.disclosure") >= REMOVE, "").otherwise(F.concat(F.lit("["), F.upper(F.substring_index("by.entity", ":", 1)), F.lit(" TERM]")))
        found = words.join(owned, [*_DOC, "term"]).select(*_DOC, "line_no", "start", "end", label.alias("label"))
        own = base.groupBy(*_DOC, "line_no").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
        found = found.join(own, [*_DOC, "line_no"], "left")
        free = ~F.exists(F.coalesce("taken", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
        spans = spans.unionByName(found.where(free).select(*_DOC, "line_no", F.lit("term").alias("kind"), "start", "end", "label"))
    return cut(spans, "spans"), lines


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*[k for k, _, _ in KINDS], "term")]), kind)


def _cleaned(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """doc key and text in which labels stand for spans (overlapping spans become the first one's label)."""
    per_line = spans.groupBy(*_DOC, "line_no").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    rows = lines.join(per_line, [*_DOC, "line_no"], "left")
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        first, last = s["start"] - F.col("at"), s["end"] - F.col("at")
        new = F.concat(a["out"], F.substring(F.col("line"), (a["to"] + 1).cast("int"), (first - a["to"]).cast("int")), s["label"])
        return F.when(first >= a["to"], F.struct(last.alias("to"), new.alias("out"))).otherwise(F.struct(F.greatest(a["to"], last).alias("to"), a["out"].alias("out")))

    done = F.aggregate("spans", start, step)
    clean = F.when(F.col("spans").isNull(), F.col("line")).otherwise(F.concat(done["out"], F.substring(F.col("line"), (done["to"] + 1).cast("int"), F.length("line"))))
    rows = rows.select(*_DOC, F.struct("line_no", clean.alias("line")).alias("l")).groupBy(*_DOC).agg(F.sort_array(F.collect_list("l")).alias("ls"))
    return rows.select(*_DOC, F.array_join(F.col("ls.line"), "\n").alias("clean"))


def _joined(only: Column | None = None) -> Column:
    """kind:start:end of the collected spans by start, then kind."""
    item = F.struct("start", _order(F.col("kind")).alias("k"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    collected = F.sort_array(F.collect_list(item if only is None else F.when(only, item)))
    return F.array_join(F.transform(collected, lambda s: s["s"]), ",")


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, personal (whether there is any span),
    clean_sha256: a row for each row of ``df``."""
    spans, lines = find(df)
    kinds = [k for k, _, _ in KINDS]
    per_doc = spans.groupBy(*_DOC).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in (*kinds, "term")],
        _joined(F.col("kind").isin(*BASE)).alias("base"), _joined().alias("spans"),
    )
    per_doc = per_doc.join(_cleaned(spans, lines), [*_DOC])
    per_doc = per_doc.withColumn("clean_sha256", F.sha2(F.col("clean").cast("binary"), 256)).drop("clean")
    docs = df.select("doc_id", _doc_key(), F.xxhash64("text").alias("text_key"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("own"))
    out = docs.join(per_doc, [*_DOC], "left")
    counts = {k: F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in (*kinds, "term")}
    return out.select(
        "doc_id", *[counts[k] for k in BASE], F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), counts["secret"], counts["term"], F.col("base").isNotNull().alias("personal"),
        F.coalesce("clean_sha256", "own").alias("clean_sha256"),
    )


def sanitise(df: DataFrame) -> DataFrame:
    """``df`` with labels in place of the spans of its texts."""
    spans, lines = find(df)
    whole = df.select(F.struct("*").alias("row"), _doc_key(), F.xxhash64("text").alias("text_key"))  # the row's own names are kept apart
    out = whole.join(_cleaned(spans, lines), [*_DOC], "left")
    return out.select(*[F.coalesce(F.col("clean"), F.col("row")["text"]).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in df.columns])
