"""Whitening, collocations and token files against brute force, a library and round trips."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import phrases, tokenbin, whitening

WORDS = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, n long, component string, v int"
DOCS = "doc_id long, text string, lang string, phrase string, word string, n int"


def exact_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[j] for r in x), n) for j in range(d)]
    c = [[r[j] - mean[j] for j in range(d)] for r in x]
    return np.array([[float(sum(r[i] * r[j] for r in c) / n) for j in range(d)] for i in range(d)])


def test_products_are_exact_to_double():
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.integers(-(2**40), 2**40, (700, 3)), rnd.integers(-5, 5, (2600, 3))])
    total = whitening.Sum((3, 3))
    whitening.add_products(total, x.astype(float), 0.0)
    exact = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(3)] for i in range(3)]
    for i in range(3):
        for j in range(3):
            off = Fraction(total.high[i, j]) + Fraction(total.low[i, j]) - exact[i][j]
            assert abs(off) <= abs(Fraction(exact[i][j])) / 2**80 + Fraction(1, 2**40)


@pytest.fixture(scope="module")
def cloud():
    rnd = np.random.default_rng(7)
    return (rnd.normal(size=(900, 6)) @ rnd.normal(size=(6, 6)) + 3).astype(np.float32)


def test_whitening_equals_exact_arithmetic(spark, cloud):
    rows = [(i, v.tolist(), 1, "x", 0) for i, v in enumerate(cloud)]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(5), components=4).toPandas().sort_values(["vec_id", "component"])
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in cloud]
    e, u = np.linalg.eigh(exact_covariance(x))
    e, u = e[::-1], u[:, ::-1]
    centred = np.array([[float(c - Fraction(sum(r[j] for r in x), len(x))) for j, c in enumerate(row)] for row in x])
    mine = got.whitened.to_numpy().reshape(-1, 4)
    theirs = (centred @ u / np.sqrt(e))[:, :4]
    for k in range(4):
        assert min(np.abs(mine[:, k] - theirs[:, k]).max(), np.abs(mine[:, k] + theirs[:, k]).max()) < 1e-10
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), (e / e.sum())[:4], rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-12 and set(got.n) == {900}
    s = [sum(r[j] for r in x) for j in range(6)]
    assert got.deviation.to_numpy().reshape(-1, 4)[:, 0].tolist() == [sum((900 * c - s[j]) ** 2 for j, c in enumerate(r)) for r in x]
    assert np.abs(np.cov(mine.T, bias=True) - np.eye(4)).max() < 1e-10


def test_whitening_of_odd_rows(spark, cloud):
    good = [(i, v.tolist(), 1, "x", 0) for i, v in enumerate(cloud[:50])]
    odd = [(100, None), (101, []), (102, [1.0] * 5 + [None]), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (105, [1e30] * 6), (106, [1.0, 2.0]), (None, cloud[0].tolist()), (3, cloud[3].tolist())]
    df = spark.createDataFrame(good + [(i, v, 1, "x", 0) for i, v in odd], VECTORS)
    got = whitening.whitened(df).toPandas()
    assert len(got) == 52 * 6 and set(got.n) == {52} and got.vec_id.isna().sum() == 6 and (got.vec_id == 3).sum() == 12
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([good[0]] * 4, VECTORS)).count() == 0  # no variance
    flat = spark.createDataFrame([(i, [float(i), 1.0, float(2 * i)], 1, "x", 0) for i in range(20)], VECTORS)
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}
    large = whitening.Mean.of([2**60, 0], 2**32)
    assert large.deviations(np.array([[2**40, 0], [2**28, 0]])).tolist() == [2**63 - 1, 0]


def brute_phrases(docs, least=10, share=50, top=2000):
    f = Counter()
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und" if lang is None else lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    n = Counter()
    for (lang, w), c in f.items():
        n[lang] += c if len(w) == 1 else 0
    out = {}
    often = {key: c for key, c in f.items() if len(key[1]) > 1 and c >= least}
    for (lang, w), a in often.items():
        if len(w) == 2 and any(100 * c >= share * a and (w in (v[:2], v[1:])) and g == lang for (g, v), c in often.items() if len(v) == 3):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(g, r, p.decode(), -a, left, right, n[g], -s) for g, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)}


def phrase_docs():
    rnd = random.Random(5)
    names = [f"W{i}" for i in range(25)] + ["Été", "naïve", "x y"]
    docs = []
    for k in range(300):
        words = []
        for _ in range(rnd.randrange(3, 40)):
            words += rnd.choice([["new", "York", "City"], ["ice", "cream"], [rnd.choice(names)], [rnd.choice(names)], [f"rare{rnd.randrange(4000)}"]])
            if rnd.random() < 0.2:
                words[-1] += rnd.choice(".,;:!?\n\r\x0b")
        docs.append((rnd.choice(["en", "de", None, ""]), rnd.choice([" ", "  ", "\t"]).join(words)))
    return docs + [("en", None), ("en", ""), (None, " \t "), ("fr", "one"), ("en", "ice cream " * 400), ("en", "a a a a a a a a a a a a. a")]


@pytest.mark.parametrize("most", [phrases.NUMBERED, 12, 1])
def test_collocations_equal_brute_force(spark, most):
    docs = phrase_docs()
    df = spark.createDataFrame([(k, t, g, "p", "w", 0) for k, (g, t) in enumerate(docs)], DOCS).repartition(4)
    got = {tuple(r) for r in phrases.collocations(df, most=most).collect()}
    assert got == brute_phrases(docs) and any(r[0] == "und" for r in got)


def test_collocations_of_short_runs_and_cuts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 64)  # texts in many parts
    docs = phrase_docs()
    df = spark.createDataFrame([(k, t, g, "p", "w", 0) for k, (g, t) in enumerate(docs)], DOCS)
    assert {tuple(r) for r in phrases.collocations(df, top=3, share=90).collect()} == brute_phrases(docs, share=90, top=3)
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(df.where("doc_id < 2")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 9_999_999_999_999_999, 10**16, 12345678901234567
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(phrases._score(row.a, row.l, row.r)).first()[0] == 1000000 * a * a // (left * right)


def test_blocks_come_back():
    rnd = np.random.default_rng(3)
    for ids in (np.zeros(0), np.array([7]), np.arange(1000), rnd.integers(0, 2**32, 777), rnd.integers(0, 49408, 5000), np.full(300, 2**32 - 1), np.where(rnd.random(4000) < 0.05, 2**31, rnd.integers(0, 9, 4000)), np.tile([0] * 127 + [2**32 - 1], 9)):
        ids = ids.astype(np.uint32)
        starts = np.array([0, len(ids) // 3, len(ids)])
        for percentile in (0, 50, 90, 100):
            f = tokenbin.TokenFile(tokenbin.to_file(ids, np.array([-5, 9]), np.array([False, True]), starts, 3, 4, percentile) + b"\n")
            assert f.ids(0, f.n_tokens).tolist() == ids.tolist() and (f.partition, f.number, f.doc_ids.tolist(), f.null.tolist(), f.starts.tolist()) == (3, 4, [-5, 9], [0, 1], starts.tolist())
            for a, b in ((0, 1), (100, 300), (127, 129), (len(ids) - 1, len(ids))):
                assert f.ids(max(0, a), min(b, len(ids))).tolist() == ids[max(0, a) : b].tolist()
    small = tokenbin.to_file(np.where(np.arange(12_800) % 20 == 0, 40_000, np.arange(12_800) % 8), np.array([1]), np.array([False]), np.array([0, 12_800]))
    assert len(small) < 12_800  # 3 bits an id and 5 % of patches, where plain ids take 2 bytes
    with pytest.raises(ValueError):
        tokenbin.TokenFile(small)  # its end is missing


def test_token_files_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    texts = [None, "", "  \n", "Hello WORLD", "été é   ΑΣ <|endoftext|>x", "a" * 300 + " " + "long text, " * 3000, "日本語   🙂", "<|startoftext|>"] + ["".join(rnd.choice("ab 'sT́é1 \t\n.<|>") for _ in range(rnd.randrange(90))) for _ in range(200)]
    rows = [(rnd.randrange(-50, 60), t, "en", "p", "w", 0) for t in texts] + [(None, "no id", "en", "p", "w", 0), (7, "seven", "en", "p", "w", 0), (7, "seven", "en", "p", "w", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    path = str(tmp_path / "tokens")
    tokenbin.write_tokens(df, WORDS, path, file_tokens=500)
    library = Tokenizer.from_file(WORDS)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert sorted((str(r.doc_id), list(r.ids)) for r in tokenbin.read_ids(spark, path).collect()) == sorted((str(r[0]), ids(r[1])) for r in rows)
    index = tokenbin.read_index(spark, path).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in index) == sorted((str(r[0]), len(ids(r[1])), crc(ids(r[1]))) for r in rows)
    index.sort(key=lambda r: r.start)
    assert [r.start for r in index] == np.concatenate([[0], np.cumsum([r.n_tokens for r in index])])[:-1].tolist()
    order = [(r.doc_id is not None, r.doc_id) for r in index]
    assert order[0] == (False, None) and order[1:] == sorted(order[1:])
    assert len(list((tmp_path / "tokens").glob("part-*"))) > 5
    assert [(r.doc_id, r.start, r.n_tokens) for r in tokenbin.digests(df, WORDS).orderBy("start").collect()] == [(r.doc_id, r.start, r.n_tokens) for r in index]


def test_token_files_of_an_empty_table(spark):
    assert tokenbin.digests(spark.createDataFrame([], DOCS), WORDS).collect() == []


def test_a_vocabulary_that_keeps_white_space_reads_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    vocab = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "two  words\n", "en", "p", "w", 0)], DOCS)
    tokenbin.write_tokens(df, vocab, str(tmp_path / "t"), end_id=50256)
    assert list(tokenbin.read_ids(spark, str(tmp_path / "t")).first().ids) == [*Tokenizer.from_file(vocab).encode("two  words\n", add_special_tokens=False).ids, 50256]
