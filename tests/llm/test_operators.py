"""Small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import itertools
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import bpe, covertree, decontaminate, lines, minhash, pages, privacy, quality, sharding, wordpiece
from loomgraph.llm.common import WordHashes, words_of

DOCS = "doc_id long, text string, part string, key string, bucket int"
VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)


def sentence(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, "   \n\t "), (None, "four little words here"), (4, "one"), (4, "one"), (5, "A b C d E f " * 9000), (None, None)]


def _all(spark, docs, labels, marks):
    return {
        "op1": minhash.near_duplicates(docs), "op2": privacy.report(docs), "op3": lines.report(docs), "op4": quality.scores(docs, labels), "op5": sharding.shards(docs),
        "op6": wordpiece.token_counts(docs, VOCAB), "op8": decontaminate.flags(docs, marks), "op9": bpe.digests(docs, VOCAB, public_tokenizers.PATTERN),
    }


def test_odd_rows_come_back_once_each(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, None), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    marks = spark.createDataFrame([(1, None), (None, ""), (3, "too short"), (4, "a b c d e f a b c d e f")], "item_id long, text string")
    for name, out in _all(spark, docs, labels, marks).items():
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((d for d, _ in ODD), key=str), name


def test_odd_rows_have_the_stated_values(spark):
    import hashlib

    import tiktoken

    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    marks = spark.createDataFrame([(1, None), (None, ""), (3, "too short"), (4, "a b c d e f a b c d e f")], "item_id long, text string")
    long = ODD[6][1]
    got = {name: {(r.doc_id, k): r for k, r in enumerate(out.orderBy("doc_id").collect())} for name, out in _all(spark, docs, labels, marks).items()}
    # rows by doc_id: null, null, 1 (null), 2 (empty), 3 (blank), 4, 4, 5 (long)
    rows = {name: list(found.values()) for name, found in got.items()}
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows["op1"][2:]] == [(0, 1, True), (0, 2, True), (0, 3, True), (1, 4, True), (1, 4, True), (6, 5, True)]
    assert sorted(r.n_shingles for r in rows["op1"][:2]) == [0, 1] and all(r.component_id is None and r.kept for r in rows["op1"][:2])
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_term, r.base_sha256, r.spans, r.personal) == (0, 0, 0, 0, 0, empty, "", False) for r in rows["op2"])
    assert [r.clean_sha256 for r in rows["op2"][2:]] == [hashlib.sha256((t or "").encode()).hexdigest() for t in (None, "", ODD[2][1], "one", "one", long)]
    assert [(r.n_lines, r.n_removed, r.n_chars) for r in rows["op3"][2:]] == [(0, 0, 0), (1, 0, 0), (2, 0, 6), (1, 0, 3), (1, 0, 3), (1, 0, len(long))]
    assert len({r.score for r in rows["op4"][2:5]}) == 1 and rows["op4"][5].score == rows["op4"][6].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows["op4"])
    assert [r["size"] for r in rows["op5"][2:]] == [8, 8, 14, 11, 11, 8 + len(long)] and all(0 <= r.shard < 24 for r in rows["op5"])
    assert [r.n_words for r in rows["op6"][2:]] == [0, 0, 0, 1, 1, 54_000] and all((r.n_tokens > 0) == (r.n_words > 0) for r in rows["op6"])
    assert [(r.contaminated, r.n_items, r.item_ids) for r in rows["op8"][2:]] == [(False, 0, "")] * 5 + [(True, 1, "4")]
    with open(VOCAB, "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Ranks(f.read()).encoder, special_tokens={})
    texts = [None, "", ODD[2][1], "one", "one", long]
    ids = [own.encode_ordinary(t or "") for t in texts]
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows["op9"][2:]] == [
        (len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, texts, strict=True)
    ]


def test_quality_equals_a_dense_fit(spark):
    """Kernel ridge weights and calibration once more, from one matrix in memory."""
    rnd = random.Random(21)
    junk = ("$$$ buy now !!! ", "||| ", "CLICK HERE ", "x1 x2 ")
    rows = [(k, " ".join(rnd.choice(junk) * 3 if k % 3 == 0 else sentence(rnd, 8) + "." for _ in range(rnd.randrange(2, 12)))) for k in range(400)]
    marks = {k: int(k % 3 > 0) if rnd.random() < 0.95 else int(k % 3 == 0) for k in range(0, 400, 2)}
    got = {r.doc_id: r for r in quality.scores(frame(spark, rows), spark.createDataFrame([(k, q, 0) for k, q in marks.items()], "doc_id long, quality int, toxic int")).collect()}
    stats = {d: np.array(quality.statistics(t)) for d, t in rows}
    taught = [d for d in marks if zlib.crc32(str(d).encode()) % 3 != 1]
    x, y = np.array([stats[d] for d in taught]), np.array([marks[d] for d in taught])
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1
    w, b = quality.Model.projection()
    z = lambda s: np.hstack([np.ones((len(s), 1)), np.sqrt(2 / w.shape[1]) * np.cos(np.clip((s - mean) / std, -8, 8) @ w + b)])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    d = w.shape[1] + 1
    # least squares of the stacked system in place of its normal equations
    stacked = np.vstack([np.sqrt(weight)[:, None] * z(x), np.sqrt(quality.RIDGE * len(y) / d) * np.eye(d)])
    beta = np.linalg.lstsq(stacked, np.concatenate([np.sqrt(weight) * (2 * y - 1), np.zeros(d)]), rcond=None)[0]
    raw = np.clip(z(x) @ beta, -2, 2)
    at = np.minimum(((raw + 2) / 4 * quality.BINS).astype(int), quality.BINS - 1)
    bins = np.unique(at)
    px, py, pw = (np.array([f(at == k) for k in bins]) for f in (lambda m: raw[m].mean(), lambda m: y[m].mean(), lambda m: m.sum()))
    fit, n = [], len(bins)
    for k in range(n):  # isotonic regression by its minimax formula
        fit.append(max(min(np.average(py[a : c + 1], weights=pw[a : c + 1]) for c in range(k, n)) for a in range(k + 1)))
    xs, ys, k = [], [], 0
    while k < n:
        j = k
        while j < n and abs(fit[j] - fit[k]) < 1e-12:
            j += 1
        xs.append(np.average(px[k:j], weights=pw[k:j]))
        ys.append(fit[k])
        k = j
    want = dict(zip(stats, np.interp(z(np.array(list(stats.values()))) @ beta, xs, ys), strict=True))
    assert max(abs(got[d].score - want[d]) for d in want) < 1e-6
    held = [d for d in marks if got[d].held_out]
    assert np.mean([got[d].predicted == int(d % 3 > 0) for d in held]) > 0.9


def test_scratch_tables_of_a_scope_go_at_its_end(spark):
    from loomgraph.llm import common

    with common.scope(spark, "stage"):
        cut = common.cut(spark.range(5), "numbers")
        folder = cut.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
        assert cut.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    marks = spark.createDataFrame([], "item_id long, text string")
    for name, out in _all(spark, docs, labels, marks).items():
        assert out.count() == 0, name
    vectors = covertree.integers(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert covertree.top_k(vectors, vectors).count() == 0
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components_of_a_chain_a_star_and_chance(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 40)] + [(rnd.randrange(900, 960), rnd.randrange(900, 960)) for _ in range(40)]
    up = {}

    def top(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = minhash.components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {k: top(k) for k in up}


def test_near_duplicates_of_planted_copies(spark):
    rnd = random.Random(1)
    rows, n = [], 0
    for _ in range(15):
        base = sentence(rnd, 120).split()
        for _ in range(4):
            copy = base[:]
            for _ in range(rnd.choice((0, 0, 1, 2, 3, 6))):
                copy[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
            rows.append((n, " ".join(copy).upper() if n % 5 == 0 else " ".join(copy)))
            n += 1
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [words_of(t)]}
    root = {d: d for d in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {d: x if r == y else r for d, r in root.items()}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == root
    assert {r.doc_id for r in minhash.keep_one(frame(spark, rows)).collect()} == set(root.values())


def test_large_cluster_of_near_copies(spark):
    rnd = random.Random(4)
    base = sentence(rnd, 60).split()
    rows = []
    for d in range(40):
        copy = base[:]
        copy[d % 60] = f"y{d}"
        rows.append((d, " ".join(copy)))
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_crowded_buckets_lose_nothing(spark):
    rnd = random.Random(9)
    passage = sentence(rnd, 60, 10**6)
    rows = [(d, passage + " " + sentence(rnd, 40, 10**6)) for d in range(60)]  # alike at about 0.42
    rows += [(100 + d, rows[d][1] + f" tail {d}") for d in range(0, 60, 3)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {d: d for d in range(60)} | {100 + d: d for d in range(0, 60, 3)}


def _components(sets, percent=75):
    """Brute force: the least doc_id that each set reaches over links; only sets that share a shingle are compared."""
    up = {d: d for d in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    holders, links = {}, 0
    for d, s in sorted(sets.items()):
        shared = {}
        for x in s:
            for e in holders.setdefault(x, []):
                shared[e] = shared.get(e, 0) + 1
            holders[x].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                links += 1
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return {d: top(d) for d in sets}, links


def test_no_planted_pair_is_lost_beside_a_frequent_passage(spark):
    rnd = random.Random(19)
    passage = sentence(rnd, 60, 10**6)
    rows = []
    for k in range(5000):  # pairs alike at 0.75 to 0.95; in a third of them both hold one passage
        text = sentence(rnd, 60, 10**6).split()
        copy = text[:]
        for _ in range(rnd.choice((1, 1, 2))):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        head = passage + " " if k % 3 == 0 else ""
        rows += [(2 * k, head + " ".join(text)), (2 * k + 1, head + " ".join(copy))]
    base = sentence(rnd, 100, 10**6).split()
    for k in range(600):  # near copies of one text, two to eight words changed
        copy = base[:]
        for j in rnd.sample(range(100), rnd.randrange(2, 9)):
            copy[j] = f"y{rnd.randrange(10**6)}"
        rows.append((20_000 + k, " ".join(copy)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [words_of(t)]}
    want, links = _components(sets)
    assert links > 4000
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("m", [100, 400])
def test_links_of_a_cluster_grow_with_its_members(spark, monkeypatch, m):
    confirmed, ties = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, sets, percent: (confirmed.append(pairs.count()), ties(pairs, sets, percent))[1])
    rnd = random.Random(m)
    base = sentence(rnd, 150, 10**6).split()
    rows = [(d, " ".join(base[: d % 150] + [f"z{d}"] + base[d % 150 + 1 :])) for d in range(m)]
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {0}
    assert sum(confirmed) <= 30 * m


def test_rare_shingles_of_alike_sets_meet(spark):
    rnd = random.Random(5)
    pool, sets = [rnd.randrange(2**62) for _ in range(80)], []
    for k in range(60):
        s = {rnd.randrange(2**62) for _ in range(rnd.randrange(1, 60))} | set(rnd.sample(pool, rnd.randrange(40)))
        sets += [(2 * k, sorted(s)), (2 * k + 1, sorted(set(rnd.sample(sorted(s), -(-len(s) * 9 // 10))) | {rnd.randrange(2**62) for _ in range(len(s) // 10)}))]
    all_of = {d: set(s) for d, s in sets}
    held = {x: sum(x in s for s in all_of.values()) for s in all_of.values() for x in s}
    prefix = {d: sorted(s, key=lambda x: (held[x], x))[: len(s) - -(-len(s) * 75 // 100) + 1] for d, s in all_of.items()}
    got = {}
    for r in minhash._rarest(spark.createDataFrame([(d, len(s), s) for d, s in sets], "rep long, n_shingles long, shingles array<long>"), 75).collect():
        got.setdefault(r.rep, {})[r.place] = r.bucket
    assert got == {d: want for d, p in prefix.items() if (want := {k: x for k, x in enumerate(p) if held[x] > 1})}
    flat = np.array([x for _, s in sets for x in s], np.uint64)
    maps = dict(zip(all_of, minhash.bitmaps(flat, np.cumsum([0, *(len(s) for _, s in sets)])).tolist(), strict=True))
    for a, b in itertools.combinations(all_of, 2):
        shared, both = len(all_of[a] & all_of[b]), len(all_of[a]) + len(all_of[b])
        differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(maps[a], maps[b], strict=True))
        assert 2 * shared <= both - differ  # the bitmaps bound what is shared from above
        if 100 * shared >= 75 * (both - shared):
            assert set(got[a].values()) & set(got[b].values())


def test_signatures_are_circulant_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 800, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    x, y = minhash.signatures([np.unique(a), np.unique(b)], 512)
    assert abs((x == y).mean() - 0.6) < 0.08
    first = minhash._mix_first((np.unique(a) >> np.uint64(32)).astype(np.uint32))
    for k in (0, 5, 511):
        shifted = first + np.uint32(k)
        assert x[k] == minhash._mix_second(shifted, np.empty_like(shifted), np.empty_like(shifted)).min()


def test_short_texts_are_one_shingle():
    h = WordHashes(seed=1)
    assert len(minhash.shingle_hashes(words_of("a b c"), h, 5)) == 1
    assert len(minhash.shingle_hashes(words_of("a b c d e f"), h, 5)) == 2
    assert len(minhash.shingle_hashes([], h, 5)) == 0


def test_lines_delete_later_runs_only(spark):
    rnd = random.Random(2)
    own = [sentence(rnd, 40, 10**6) for _ in range(12)]
    run = [sentence(rnd, 20, 10**6) for _ in range(4)]  # 80 words in lines of 20
    short = sentence(rnd, 20, 10**6)
    rows = [
        (1, "\n".join([own[0], *run, own[1]])), (2, "\n".join([own[2], "", *run[:2], "", *run[2:], own[3]])), (3, "\n".join([*run, own[4], *run])),
        (4, "\n".join([own[5], short])), (5, "\n".join([short, own[6]])), (6, "\n".join(run)), (7, own[7] + "\n" + own[8]), (8, own[7] + "\n" + own[8]),
    ]
    got = {r.doc_id: r.text for r in lines.deduplicate(frame(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "\n".join([own[2], "", "", own[3]]) and got[3] == own[4]
    assert got[4] == rows[3][1] and got[5] == rows[4][1]
    assert got[6] == "" and got[7] == rows[6][1] and got[8] == ""
    assert {r.doc_id for r in lines.without_repeats(frame(spark, rows)).collect()} == {1, 2, 3, 4, 5, 7}


def _repeated_lines(docs, least=50):
    """Brute force, without fingerprints: positions in every later copy of any run of whole lines of ``least`` words."""
    first, gone = {}, set()
    for d, text in sorted(docs):
        lines = [(p, line) for p, line in enumerate(text.split("\n")) if line.strip()]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(line for _, line in lines[a : b + 1])
                if sum(len(line.split()) for line in run) >= least and first.setdefault(run, (d, a)) != (d, a):
                    gone.update((d, p) for p, _ in lines[a : b + 1])
    return gone


def test_lines_find_runs_whose_parts_stand_alone_before(spark):
    rnd = random.Random(12)
    passage = [sentence(rnd, 12, 10**6) for _ in range(6)]  # 72 words
    # earlier documents hold each part of 48 words alone: every fingerprint's first place is too short a run
    rows = [(k, "\n".join([sentence(rnd, 30, 10**6), *passage[k : k + 4], sentence(rnd, 30, 10**6)])) for k in range(3)]
    rows += [(10 + k, "\n".join([sentence(rnd, 30, 10**6), *passage[:3], " ", *passage[3:], sentence(rnd, 30, 10**6)])) for k in range(3)]
    own = ["\n".join(part) for part in (passage[:4], [sentence(rnd, 30, 10**6)], [passage[1]], [sentence(rnd, 30, 10**6)])]
    rows += [(20, "\n".join(own))]
    pool = [sentence(rnd, n, 10**6) for n in (1, 3, 7, 9, 14, 20, 26, 33, 49, 60)]
    rows += [(30 + k, "\n".join(rnd.choice([*pool, ""]) for _ in range(rnd.randrange(4, 14)))) for k in range(60)]
    gone = _repeated_lines(rows)
    assert {(d, p) for d, p in gone if d < 30} == {(d, p) for d in (11, 12) for p in (1, 2, 3, 5, 6, 7)}
    got = {r.doc_id: r.text for r in lines.deduplicate(frame(spark, rows)).collect()}
    assert got == {d: "\n".join(line for p, line in enumerate(text.split("\n")) if (d, p) not in gone) for d, text in rows}


def test_masks_fit_between_any_three_substitutions():
    masks = [sum(1 << i for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS]
    for gaps in itertools.combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.LEAST):
        missing = sum(1 << g for g in gaps)
        assert any(not (m << s) & missing for m in masks for s in range(decontaminate.WINDOW - m.bit_length() + 1))


def test_leaks_with_substitutions_are_found(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)  # several blocks
    rnd = random.Random(6)
    items = [(k, sentence(rnd, 20, 10**6)) for k in range(20)] + [(20, "alpha beta gamma delta epsilon"), (21, None)]
    rows = []
    for d in range(40):
        words = sentence(rnd, 100, 10**6).split()
        if d % 2:
            leak = items[d // 2][1].split()
            for j in rnd.sample(range(20), 3):
                leak[j] = "changed"
            words[50:50] = leak
        rows.append((d, " ".join(words)))
    rows += [(50, "so Alpha, beta gamma delta epsilon."), (51, "alpha beta changed delta epsilon")]
    got = {r.doc_id: r.item_ids for r in decontaminate.flags(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect() if r.contaminated}
    assert got == {d: str(d // 2) for d in range(1, 40, 2)} | {50: "20"}
    kept = decontaminate.keep_clean(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(0, 40, 2)) | {51}


def test_repeated_and_unnamed_items_in_blocks(spark, monkeypatch):
    item = sentence(random.Random(3), 15, 10**6)
    one = decontaminate._blocks(spark.createDataFrame([(1, item)], "item_id long, text string").crossJoin(spark.range(50_000)).drop("id"))
    assert one[0] == 1 and [len(b) for b in one[1]] == [1]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    others = [(k, sentence(random.Random(k), 15, 10**6)) for k in range(10, 16)]
    items = spark.createDataFrame([(7, item)] * 50 + [(None, item), (8, item), *others, (None, None)], "item_id long, text string")
    docs = frame(spark, [(1, f"x {item} y"), (None, item), (2, "nothing of it"), (3, None), (4, f"{others[0][1]} and {item}"), (4, f"{others[0][1]} and {item}")])
    got = sorted((str(r.doc_id), r.n_items, r.item_ids) for r in decontaminate.flags(docs, items).collect())
    assert got == [("1", 3, "7,8"), ("2", 0, ""), ("3", 0, ""), ("4", 4, "7,8,10"), ("4", 4, "7,8,10"), ("None", 3, "7,8")]
    assert sorted(str(r.doc_id) for r in decontaminate.keep_clean(docs, items).collect()) == ["2", "3"] and decontaminate.keep_clean(docs, items).columns == docs.columns
    assert decontaminate.matches(docs, items).count() == 14
    assert decontaminate.flags(docs.where("false"), items).count() == 0


def test_repetitive_texts_are_searched_in_short_time(spark):
    import time

    items = [(1, "la di da " * 1000), (2, "tick tock " * 6), (3, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    began = time.time()
    block = decontaminate.Items(items)
    hashes = decontaminate._Stripped(seed=2)
    found = []
    for text in ("la " * 60_000, "la di da " * 60_000, "tick tock " * 90_000 + "one two three four X six seven eight nine ten eleven twelve"):
        flat = hashes.of(words_of(text))
        found.append([item for _, item, *_ in block.found_in(flat, np.array([0]), np.array([len(flat)]), once=True)])
    assert found == [[], [1], [2, 3]] and time.time() - began < 60


def test_offsets_of_repetitive_texts_are_all_found(monkeypatch):
    rnd = random.Random(3)
    hashes = decontaminate._Stripped(seed=2)
    for n in range(20):
        items = [(k, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(10, 40)))) for k in range(3)]
        rows = [hashes.of([rnd.choice((b"a", b"b", b"c")) for _ in range(rnd.randrange(1, 90))]) for _ in range(4)]
        ends = np.cumsum([len(r) for r in rows])
        starts = ends - [len(r) for r in rows]
        got = []
        for spread in (1 << 21, 1 << 5):
            monkeypatch.setattr(decontaminate, "_SPREAD", spread)
            got.append(list(decontaminate.Items(items).found_in(np.concatenate(rows), starts, ends)))
        want = []
        for d, row in enumerate(rows):
            for k, item in items:
                w = hashes.of(words_of(item))
                for first in range(-len(w), len(row)):
                    same = [p for p in range(len(w)) if 0 <= first + p < len(row) and row[first + p] == w[p]]
                    good = [i for i in range(len(same) - 9) if same[i + 9] - same[i] < 13]
                    if good:
                        x, y = same[good[0]], same[good[-1] + 9]
                        want.append((d, k, first + x, y - x + 1, sum(x <= p <= y for p in same)))
        assert [tuple(map(int, x)) for x in got[0]] == got[1] == want


def test_rows_are_decided_by_their_text(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "mu nu xi omicron pi rho"), (1, "mu nu xi omicron pi rho")], "item_id long, text string")
    leak = "so alpha beta gamma delta epsilon zeta eta theta iota kappa then"
    rows = [(None, leak), (None, "nothing of this kind"), (1, leak), (1, "other words"), (2, "mu nu xi omicron pi rho")]
    docs = spark.createDataFrame([(*r, "a", 2) for r in rows], "doc_id long, text string, items string, c0 int")
    got = sorted((str(r.doc_id), r.contaminated, r.n_items, r.item_ids) for r in decontaminate.flags(docs, items).collect())
    assert got == [("1", False, 0, ""), ("1", True, 1, "1"), ("2", True, 2, "1"), ("None", False, 0, ""), ("None", True, 1, "1")]
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["nothing of this kind", "other words"]


def test_terms_that_give_an_entity_away(spark):
    rnd = random.Random(8)
    rows = [(k, sentence(rnd, 12) + f"\nplain filler words number {k} again") for k in range(300)]
    rows += [(1000 + k, f"the zebracorn writes from boss@corp.example about {k} plain filler words") for k in range(4)]
    got = {r.doc_id: r for r in privacy.report(frame(spark, rows)).collect()}
    text = rows[-1][1]
    at = text.index("zebracorn")
    assert f"term:{at}:{at + 9}" in got[1003].spans and got[1003].n_email == 1
    assert "term" not in got[5].spans and got[5].n_term == 0
    clean = {r.doc_id: r.text for r in privacy.sanitise(frame(spark, rows)).collect()}
    assert "boss@" not in clean[1003] and "zebracorn" not in clean[1003] and "plain filler words" in clean[1003] and clean[5] == rows[5][1]


@pytest.mark.parametrize("keys", [privacy.BROADCAST_KEYS, 0])
def test_terms_beside_entities_seen_once(spark, monkeypatch, keys):
    monkeypatch.setattr(privacy, "BROADCAST_KEYS", keys)
    rnd = random.Random(9)
    names = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(60)]
    said = [" ".join(rnd.choice(names) for _ in range(6)) for _ in range(500)]
    rows = [(k, "\n".join(said[4 * k : 4 * k + 4])) for k in range(125)] + [(200 + k, said[7] + "\nalways the same quagga line") for k in range(40)]
    rows += [(300, f"the zebracorn and {names[0]} met\nwrite to zebracorn or quagga at one@corp.example {names[1]}")]
    rows += [(301, f"okapi of two@corp.example {names[2]} {names[3]}\nokapi again"), (302, f"okapi takes two@corp.example and one@corp.example {names[4]}")]
    contexts = {line for _, text in rows for line in text.split("\n")}
    terms = {c: set(re.findall("[a-z]{4,}", c)) for c in contexts}
    want = {}
    for d, text in rows:
        for line in text.split("\n"):
            for mail in re.findall(r"[a-z]+@corp\.example", text):
                held = [c for c in contexts if mail in c]
                for m in re.finditer("[a-z]{4,}", line):
                    n_ct, n_t, p = sum(m[0] in terms[c] for c in held), sum(m[0] in ts for ts in terms.values()), len(held) / len(contexts)
                    if n_ct and not any(e.start() < m.end() and m.start() < e.end() for e in re.finditer(r"[a-z]+@corp\.example", line)):
                        share = np.log2((n_ct + p) / (n_t + 1) / p) / -np.log2(p)
                        if share >= privacy.GENERALISE:
                            want.setdefault(d, set()).add(m[0])
    assert {"zebracorn", "quagga"} <= want[300] and "okapi" in want[301] and not want[300] & set(names)
    got = {r.doc_id: r for r in privacy.report(frame(spark, rows)).collect()}
    texts = dict(rows)
    spans = {d: {texts[d][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"} for d, r in got.items()}
    assert {d: v for d, v in spans.items() if v} == want
    clean = {r.doc_id: r.text for r in privacy.sanitise(frame(spark, rows)).collect()}
    assert "zebracorn" not in clean[300] and names[0] in clean[300] and clean[200] == texts[200]
    # an entity in every line has nothing to give away
    assert [r.n_term for r in privacy.report(frame(spark, [(1, "only line of a@b.example")])).collect()] == [0]


def _contexts(line, most=1024):
    """Parts of a line of at most 1,024 characters, ended where no letter follows, found one by one."""
    at, out = 0, []
    while at < len(line):
        end = min(len(line), at + most)
        while end > at and end < len(line) and line[end].isalpha():
            end -= 1
        end = end if end > at else min(len(line), at + most)
        out.append((at, line[at:end]))
        at = end
    return out


def test_disclosure_in_parts_of_long_lines(spark):
    rnd = random.Random(10)
    names = ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(90)]
    talk = lambda n: " ".join(rnd.choice(names) for _ in range(n))
    rows = [(k, "\n".join(talk(9) for _ in range(3))) for k in range(200)]
    rows += [(300, f"{talk(200)} quokka one@corp.example numbat {talk(300)} wombat {talk(10)}\n{talk(8)} numbat"), (301, "z" * 3000 + f" one@corp.example bandicoot {talk(400)} 10.1.2.3 bilby"), (302, f"{talk(6)} quokka 10.1.2.3")]
    pieces = {p for _, text in rows for line in text.split("\n") for _, p in _contexts(line)}
    terms = {p: set(re.findall("[a-z]{4,}", p)) for p in pieces}
    said = r"one@corp\.example|10\.1\.2\.3"
    want = {}
    held = {}
    for _, text in rows:
        for line in text.split("\n"):
            for m in re.finditer(said, line):
                held.setdefault(m[0], set()).add(next(p for at, p in _contexts(line) if at <= m.start() < at + len(p)))
    for d, text in rows:
        for c in set(re.findall(said, text)):
            p = len(held[c]) / len(pieces)
            for t in {t for line in text.split("\n") for _, x in _contexts(line) for t in re.findall("[a-z]{4,}", re.sub(said, " ", x))}:
                n_ct, n_t = sum(t in terms[x] for x in held[c]), sum(t in ts for ts in terms.values())
                if n_ct and np.log2((n_ct + p) / (n_t + 1) / p) / -np.log2(p) >= privacy.GENERALISE:
                    want.setdefault(d, set()).add(t)
    assert {"quokka", "numbat"} <= want[300] and "wombat" not in want[300] and {"bandicoot", "bilby"} <= want[301] and "quokka" in want[302]
    got = {r.doc_id: r for r in privacy.report(frame(spark, rows)).collect()}
    texts = dict(rows)
    spans = {d: {texts[d][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"} for d, r in got.items()}
    assert {d: v for d, v in spans.items() if v} == want


def test_clashing_columns_are_kept(spark):
    names = ["clean", "_clean", "row", "doc_key", "text_key", "_gone", "_d", "_t", "gone", "_lines", "_removed", "_emptied", "_touched", "split"]
    run = "\n".join(" ".join(f"word{k}{j}" for j in range(20)) for k in range(4))
    rows = [(1, run), (2, run + "\nwrite to a@b.example"), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    for out in (privacy.sanitise(docs), lines.without_repeats(docs)):
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == 4 and all(tuple(r[c] for c in names) == tuple(names) for r in got.values())
        assert got[1].text == run and got[None].text is None and got[3].text == ""
    assert {r.doc_id: r.text for r in lines.without_repeats(docs).collect()}[2] == "write to a@b.example"


def test_sharding_of_one_hot_text(spark):
    rows = [(k, "the same text over and over") for k in range(3000)] + [(5000 + k, f"other {k} " * 3) for k in range(1000)]
    got = sharding.shards(frame(spark, rows)).collect()
    total = [0] * 24
    for r in got:
        total[r.shard] += r["size"]
    assert len(got) == 4000 and max(total) - min(total) < 0.03 * sum(total) / 24 + 80


@pytest.mark.parametrize("seed", range(3))
def test_cover_tree_holds_every_point(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(0, 100, (400, 3)))
    x[100:150] = x[7]
    seen = []

    def walk(node):
        assert (np.sqrt(((x[node.points] - node.centre) ** 2).sum(1)) <= node.radius + 1e-6).all()
        if not node.children:
            seen.extend(node.points.tolist())
        for c in node.children:
            walk(c)

    walk(covertree.cover_tree(x))
    assert sorted(seen) == list(range(400))


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 300, (60, 32))
    x = np.floor(centres[rng.integers(0, 60, 6000)] + rng.normal(0, 6, (6000, 32)))
    ids = np.arange(6000)
    search = covertree.Search(ids[:300], x[:300], 5)
    for at in range(0, 6000, 3000):
        search.add(ids[at : at + 3000], x[at : at + 3000])
    assert search.compared < 0.2 * 300 * 6000
    for q in range(0, 300, 17):
        s = x @ x[q]
        assert search.found[q].tolist() == sorted((k for k in range(6000) if k != q), key=lambda k: (-s[k], k))[:5]


def test_queries_in_blocks_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 10)
    monkeypatch.setattr(covertree, "DATA_BLOCK", 64)
    rng = np.random.default_rng(6)
    rows = [(k % 150, [float(v) for v in rng.normal(0, 1, 8)]) for k in range(400)]  # ids up to three times
    vectors = covertree.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in covertree.top_k(vectors, vectors.where("vec_id % 3 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = [(k, [int(np.floor(256 * x)) for x in v]) for k, v in rows]
    assert set(got) == set(range(0, 150, 3))
    for q, found in got.items():
        own = min(v for k, v in ints if k == q)
        want = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), k) for k, v in ints if k != q)[:5]
        assert sorted(found) == [(n + 1, k, -s) for n, (s, k) in enumerate(want)]


def test_search_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in rng.integers(-2, 3, 4) / 4]) for k in range(300)]
    rows += [(400, None), (401, [None, 1.0, 1.0, 1.0]), (402, [float("nan")] * 4), (403, [1.0, 2.0]), (404, []), (None, [1.0] * 4), (450, [2.0, 1.0])]
    vectors = covertree.integers(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int"))
    got = covertree.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()
    fine = {k: np.floor(256 * np.array(v)) for k, v in rows[:300]} | {403: np.array([256.0, 512]), 450: np.array([512.0, 256])}
    for q in (0, 50, 100, 150, 200, 250, 450):
        want = sorted((-int(fine[q] @ v), k) for k, v in fine.items() if k != q and len(v) == len(fine[q]))[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert not any(r.query_id == 400 for r in got)


def test_bpe_round_trip_and_overlaps(spark):
    texts = ["aaaaaaaaa aaaa", "  two  spaces \n \n mixed\t", "naïve 😀 東京 ١٣", "'s don't", "\x1c odd", ""]
    docs = frame(spark, list(enumerate(texts)))
    back = bpe.decode(bpe.encode(docs, VOCAB, public_tokenizers.PATTERN), VOCAB).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == dict(enumerate(texts))


def test_pages_with_other_layouts():
    forest = pages.model()
    words = "Plain words, which make a sentence of some length and then another one."
    around = '<header class="site-header"><a href="/">Home</a></header><div id="cookie-banner"><p>We use cookies.</p><button>OK</button></div><aside class="sidebar"><p>Side words here.</p></aside>'
    below = '<section id="comments"><h3>Comments</h3><p>A reader says something quite long about all of this.</p></section><footer>Fine print</footer>'
    source = f'<html><body>{around}<div class="content"><h1>Title &amp; more</h1><p>{words}</p><p>{words}<br>Last&nbsp;line</p><form><input name="q"><button>Go</button></form></div>{below}</body></html>'
    assert pages.main_texts([source], forest) == [f"Title & more {words} {words} Last line"]
    assert pages.main_texts([None, "", "<", "</", "<p", "<!-- x", "<script>var a = '<p>'"], forest)[:2] == ["", ""]


def test_pages_are_parsed_in_time_proportional_to_their_length():
    import time

    def took(source):
        t = time.time()
        pages.Page(source)
        return time.time() - t

    for part in ("<div>", "<b>", "<video>", "<li>", "<a href='", "<ul><li>"):
        for tail in ("</x>", "</li>", "</p>", "<hr>", "<td>", "<p>"):
            small, large = (min(took(part * n + tail * n) for _ in range(2)) for n in (4000, 16000))
            assert large < 9 * small + 0.15, (part, tail, small, large)


def _tree(source):
    page = pages.Page(source)
    return [(t, page.parents[k]) for k, t in enumerate(page.tags)][1:]


def test_open_elements_end_where_html_ends_them():
    assert _tree("<p>a<p>b<div>c</div>") == [("p", 0), ("p", 0), ("div", 0)]
    assert _tree("<ul><li>a<b>x<li>b<ul><li>c</li></li></ul><li>d</ul><p>") == [("ul", 0), ("li", 1), ("b", 2), ("li", 1), ("ul", 4), ("li", 5), ("li", 1), ("p", 0)]
    assert _tree("<table><tr><td>a<td>b<tr><td>c</table><i>") == [("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 5), ("i", 0)]
    assert _tree("<div><span></x></section><p></div></p><hr>") == [("div", 0), ("span", 1), ("p", 2), ("hr", 0)]


def test_unclosed_media_and_formulas_lose_no_text():
    forest = pages.model()
    words = "Plain words, which make a sentence of some length and then another one."
    page = lambda inner: f'<html><body><header class="site-header"><a href="/">Home</a></header><article><h1>Title</h1>{inner}<p>{words}</p></article><footer>Fine print</footer></body></html>'
    sources = [page("<video src='x'>"), page("<object>"), page("<svg><path></svg><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, they say in words of this kind.</p>"), page("<p>Fish &am<b>p;</b> chips &amp; more, which they say is good to eat.</p>")]
    got = pages.main_texts(sources, forest)
    assert got[:2] == [f"Title {words}"] * 2
    assert got[2] == f"Title So x=1, they say in words of this kind. {words}" and got[3] == f"Title Fish &amp; chips & more, which they say is good to eat. {words}"


def test_pages_against_the_grammar_are_exact():
    """Hostile markup, names that say the contrary, and a list of links: none is of the training grammar."""
    forest = pages.model()
    first, second = "Some words that go on, and on for a while. " * 6, "Another paragraph, with commas, and so on and so on. " * 5
    story = f"<h1>The title of it</h1><p>{first}</p><p>{second}</p>"
    text = " ".join(f"The title of it {first} {second}".split())
    page = lambda inner: f"<html><head><title>t</title></head><body><nav><ul><li><a href=/x/>Home</a></li><li><a href=/y>News</a></li></ul></nav>{inner}<footer><p>copyright 2020</p></footer></body></html>"
    sources = {
        "a quote inside an unquoted value": "<article>" + story.replace("<p>", "<p data-x=it's>", 1) + "</article>", "a comment ended by --!>": f"<!-- nav --!><article>{story}</article>",
        "an empty comment": f"<!--> <article>{story}</article>", "a slash that means nothing": f'<div class="x"/><article>{story}</article></div>', "a bracket in a value": f'<article data-a="x > y">{story}</article>',
        "names of the other kind": f'<div class="page-header-main"><div class="message-body">{story}</div></div>', "a value with a slash": f"<article><p class=a/>{story}</article>",
    }
    got = dict(zip(sources, pages.main_texts([page(s) for s in sources.values()], forest), strict=True))
    assert got == dict.fromkeys(sources, text)
    entries = "".join(f'<li><a href="/{i}">Entry number {i} of this fine list, with a longer title</a></li>' for i in range(20))
    wanted = "Twenty links " + " ".join(f"Entry number {i} of this fine list, with a longer title" for i in range(20))
    assert pages.main_texts([page(f"<article><h1>Twenty links</h1><ul>{entries}</ul></article>")], forest) == [wanted]
    assert _tree("<p/>a<math><mi/><mo>+</mo></math><br/><hr/>") == [("p", 0), ("math", 1), ("mi", 2), ("mo", 2), ("br", 1), ("hr", 0)]


def test_page_rows_come_back_as_they_are(spark):
    rows = [(1, "u", "<article><p>Some words, said here.</p></article>", "x")] * 2 + [(None, None, None, "y"), (2, "v", "", None)]
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [("1", "u", "Some words, said here.", 22)] * 2 + [("2", "v", "", 0), ("None", "None", "", 0)]


def test_decoding_never_keeps_below_a_dropped_node():
    rng = np.random.default_rng(1)
    parent = [-1, *(int(rng.integers(0, k)) for k in range(1, 200))]
    kept = pages.decode(rng.random(200), parent)
    assert all(not kept[k] or kept[parent[k]] for k in range(1, 200))


def test_held_out_pages():
    forest, right, total = pages.model(), 0, 0
    for source, labels in pages.training_pages(60, seed=99):
        page = pages.Page(source)
        kept = pages.decode(forest.chance(pages.features(page, forest.weights)), page.parents)
        right += sum(a == b for a, b in zip(kept, labels, strict=False))
        total += len(kept)
    assert right / total > 0.98


def test_statistics_need_no_words():
    assert quality.statistics(None) == quality.statistics(" \n") == [0.0] * len(quality.FEATURES)
