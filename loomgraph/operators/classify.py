"""Pluggable embedders, classifiers and extractors behind misses-only caches.

Offline defaults are deterministic. A callable gets a list and returns a list of the same length; transient errors are
retried with growing waits, others become the ``error`` of their rows. Only rows that are not in the cache are computed.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, without_fences
from ..schemas import SchemaSpec, spec
from .candidates import first_wins

#: Status codes, as whole numbers, and words of errors that pass.
TRANSIENT = re.compile(r"(?<![0-9])(?:429|500|502|503|504)(?![0-9])|timeout|timed out|temporarily|unavailable|overloaded|rate limit|resource exhausted|connection", re.I)


def transient(error: Exception) -> bool:
    """Whether a call may be repeated: by its status code if the error carries one, else by its message."""
    code = getattr(error, "status_code", None) or getattr(error, "code", None)
    if isinstance(code, int):
        return code == 429 or 500 <= code < 600
    return not isinstance(error, (TypeError, KeyError, AttributeError)) and TRANSIENT.search(str(error)) is not None


def retried(call: Callable[[list], list], tries: int = 5, first_wait: float = 10.0, longest: float = 120.0, jitter: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list], list]:
    """The call, repeated on transient errors with doubled waits, each longer by a random share up to ``jitter``."""

    def run(items: list) -> list:
        wait = first_wait
        for left in range(tries - 1, -1, -1):
            try:
                return call(items)
            except Exception as e:
                if not left or not transient(e):
                    raise
                sleep(min(wait, longest) * (1 + jitter * random.random()))
                wait *= 2
        return []

    return run


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic vectors from token hashes (X01, offline)."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            for token in (text or "").lower().split():
                h = hashlib.md5(token.encode()).digest()
                v[int.from_bytes(h[:4], "big") % dimension] += 1.0 if h[4] % 2 else -1.0
            out.append(v)
        return out

    return embed


def rule_classifier(pairs: list[dict]) -> list[dict]:
    """Deterministic stand-in for a language model: equal names, containment, else related or none by score (X02, offline)."""
    out = []
    for k, p in enumerate(pairs):
        a, b, s = (p.get("name_a") or "").lower().strip(), (p.get("name_b") or "").lower().strip(), p.get("score") or 0.0
        kind, conf = ("SAMA_DENGAN", 0.95) if a and a == b else ("MEMPERDALAM", 0.8) if a and b and (a in b or b in a) else ("BERKAITAN_DENGAN", round(s, 3)) if s >= 0.7 else ("none", round(1 - s, 3))
        out.append({"pair_index": k, "rel_type": kind, "confidence": conf, "direction": "a_to_b", "description": f"{p.get('name_a')} / {p.get('name_b')}", "evidence": ""})
    return out


def embed_misses(texts: DataFrame, cache: DataFrame, model: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """cache rows (key, model, vector) for the texts (text) that have none."""
    keyed = texts.select("text", cache_key(F.col("text"), F.lit(model)).alias("key")).where("text is not null").dropDuplicates(["key"])
    todo = keyed.join(cache.select("key"), "key", "left_anti")
    embedder = retried(embedder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"key": part["key"], "model": model, "vector": embedder(part["text"].tolist())})

    return todo.select("key", "text").mapInPandas(run, "key string, model string, vector array<float>")


def classify_misses(pairs: DataFrame, cache: DataFrame, classifier: Callable[[list[dict]], list[dict]], classes: tuple[str, ...], batch: int = 20) -> DataFrame:
    """key, rel_type, confidence, direction, description, evidence, error of the pairs (key, ...) that the cache lacks.

    Answers are put back by pair_index; missing ones are none at 0; types outside the classes are none; confidences
    are held in [0, 1]. A failed batch carries its error and must not be cached.
    """
    todo = pairs.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    classifier = retried(classifier)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                rows, error = part.to_dict("records"), None
                try:
                    answers = {a.get("pair_index"): a for a in classifier(rows)}
                except Exception as e:
                    answers, error = {}, str(e)[:500]
                out = []
                for k, r in enumerate(rows):
                    a = answers.get(k) or {}
                    kind = a.get("rel_type") if a.get("rel_type") in classes else "none"
                    conf = min(1.0, max(0.0, float(a.get("confidence") or 0.0))) if a else 0.0
                    out.append((r["key"], kind, conf, a.get("direction"), a.get("description") or "", a.get("evidence") or "", error))
                yield pd.DataFrame(out, columns=["key", "rel_type", "confidence", "direction", "description", "evidence", "error"])

    return todo.mapInPandas(run, "key string, rel_type string, confidence double, direction string, description string, evidence string, error string")


def for_schema(name: str) -> tuple[SchemaSpec, tuple[str, ...], Callable[[Column, Column], Column]]:
    """Ontology, answer classes, and the type under which an answer (class, confidence) is stored: with the ontology's prefix, null for none.

    What a classifier asks and what becomes of its answers is decided by the registered spec, not by the look of a label (X08, X13).
    """
    ontology = spec(name)

    def stored(kind: Column, confidence: Column) -> Column:
        known = kind.isin(*[c for c in ontology.classes if c != "none"]) & (F.coalesce(confidence, F.lit(0.0)) > 0)
        return F.when(known, F.concat(F.lit(ontology.typed_prefix), kind))

    return ontology, ontology.classes, stored


def classified(pairs: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """All pairs with their answer from cache or run; nothing known is none at 0."""
    known = cache.select("key", "rel_type", "confidence", "description", F.lit(True).alias("cached")).unionByName(fresh.select("key", "rel_type", "confidence", "description", F.lit(False).alias("cached")))
    out = pairs.join(first_wins(known, ["key"], [F.desc("cached")]), "key", "left")
    return out.withColumns({"rel_type": F.coalesce("rel_type", F.lit("none")), "confidence": F.coalesce("confidence", F.lit(0.0)), "description": F.coalesce("description", F.lit(""))})


def cache_put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Cache with new rows; failures stay out, the latest row of a key wins (X12). Rows: key, ..., written (timestamp)."""
    good = rows.where("error is null").select(*cache.columns) if "error" in rows.columns else rows.select(*cache.columns)
    return first_wins(cache.unionByName(good), ["key"], [F.desc("written")])


def cache_maintenance(cache: DataFrame, today: str, days: int) -> DataFrame:
    """Rows younger than a number of days before a given day."""
    return cache.where(F.to_date("written") >= F.date_sub(F.lit(today).cast("date"), days))


def cache_stats(files: DataFrame) -> DataFrame:
    """kind, files, megabytes of a listing (path, length)."""
    kind = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return files.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("length") / 1048576, 3).alias("megabytes"))


def extract(texts: DataFrame, extractor: Callable[[str], str], schema: str) -> DataFrame:
    """id, parsed struct, error from an extractor that answers JSON, fenced or not."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, text in zip(f["id"], f["text"], strict=True):
                try:
                    out.append((i, extractor(text), None))
                except Exception as e:
                    out.append((i, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["id", "answer", "error"])

    raw = texts.select("id", "text").mapInPandas(run, "id string, answer string, error string")
    parsed = F.from_json(without_fences(F.col("answer")), schema)
    return raw.select("id", parsed.alias("parsed"), F.when(F.col("error").isNull() & parsed.isNull(), "not JSON").otherwise(F.col("error")).alias("error"))


def keyword_extractor(text: str) -> str:
    """Offline extractor: capitalised words of a text as concepts."""
    words = dict.fromkeys(w.strip(".,;:") for w in (text or "").split() if w[:1].isupper())
    return json.dumps({"concepts": [{"name": w, "relations": []} for w in words if w]})
