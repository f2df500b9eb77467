"""Terms of a corpus by C-value: phrases that stand often, less where they only stand inside longer ones.

Sentences are cut at punctuation and line ends; phrases are runs of ``SHORTEST`` to ``LONGEST`` words that neither begin nor end with a stopword.

    C(a) = log2 |a| * (f(a) - mean of f(b) over the longer candidates b that hold a)

Counting is one aggregation of all phrases, nesting a join of the frequent ones with the parts of the frequent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from .tables import cut, spread

SHORTEST, LONGEST, LEAST = 2, 4, 10
#: Texts of a task, about, however few pieces their files can be read in.
TASK_TEXTS = 1_000
#: Ends of a sentence; what separates words in it.
SENTENCES, SPACES = r"[.,;:!?()\x0A-\x0D]+", r"[\x20\x09]+"


def _runs(words: Column, n: int) -> Column:
    """All runs of n words of a phrase, joined by a space."""
    last = F.size(words) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def phrases(texts: DataFrame, text_col: str = "text", stopwords: tuple[str, ...] = STOPWORDS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """phrase, n: counts of the candidate phrases."""
    sentence = F.explode(F.split(F.lower(F.coalesce(text_col, F.lit(""))), SENTENCES))
    words = spread(texts.select(text_col), rows=TASK_TEXTS).select(sentence.alias("s")).select(F.filter(F.split("s", SPACES), lambda w: w != "").alias("w")).where(F.size("w") >= shortest)
    rows = words.select("w", F.col("w").alias("r1"))
    for n in range(2, longest + 1):  # each run from the one that is a word shorter: work grows with the words of a sentence, however long it is
        kept = F.slice(f"r{n - 1}", F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(0)))
        rows = rows.withColumn(f"r{n}", F.zip_with(kept, F.slice("w", F.lit(n), F.size("w")), lambda r, w: F.concat(r, F.lit(" "), w)))
    rows = rows.select(F.explode(F.flatten(F.array(*[f"r{n}" for n in range(shortest, longest + 1)]))).alias("phrase"))
    if stopwords:
        rows = rows.where(~F.substring_index("phrase", " ", 1).isin(*stopwords) & ~F.substring_index("phrase", " ", -1).isin(*stopwords))
    return rows.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def extracted_terms(
    texts: DataFrame, text_col: str = "text", stopwords: tuple[str, ...] = STOPWORDS, least: int = LEAST, shortest: int = SHORTEST, longest: int = LONGEST
) -> DataFrame:
    """phrase, words, n, nested (longer candidates that hold it), c_value: candidates that stand ``least`` times and have a C-value above 0."""
    found = cut(phrases(texts, text_col, stopwords, shortest, longest).where(F.col("n") >= least).withColumn("words", F.size(F.split("phrase", " "))))
    w = F.split("phrase", " ")
    parts = F.array_distinct(F.flatten(F.array(*[F.when(F.col("words") > k, _runs(w, k)).otherwise(F.array().cast("array<string>")) for k in range(shortest, longest)])))
    inside = found.where(F.col("words") > shortest).select(F.explode(parts).alias("phrase"), F.col("n").alias("m"))
    nests = inside.groupBy("phrase").agg(F.count(F.lit(1)).alias("nested"), F.sum("m").alias("held"))
    rows = found.join(nests, "phrase", "left")
    share = F.coalesce(F.col("held") / F.col("nested"), F.lit(0.0))
    out = rows.select("phrase", "words", "n", F.coalesce("nested", F.lit(0)).alias("nested"), (F.log2(F.col("words").cast("double")) * (F.col("n") - share)).alias("c_value"))
    return out.where(F.col("c_value") > 0)


def term_extractor(terms: set[str]):
    """A ``classify.extract`` extractor: the known terms of a text, in the order they come, as concepts."""
    import json
    import re

    most = max((t.count(" ") + 1 for t in terms), default=0)

    def run(text: str) -> str:
        out: dict[str, None] = {}
        for sentence in re.split(SENTENCES, (text or "").lower()):
            w = [x for x in re.split(SPACES, sentence) if x]
            for i in range(len(w)):
                for n in range(min(most, len(w) - i), 0, -1):
                    if (t := " ".join(w[i : i + n])) in terms:
                        out.setdefault(t)
                        break
        return json.dumps({"concepts": [{"name": t, "relations": []} for t in out]})

    return run
