"""The opN_ queries against their oracle SQL or brute force on the fixture tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from loomgraph.llm import queries, wordpiece


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLES[name]))


def _documents(duck):
    return duck.sql("select doc_id, text from documents").fetchall()


def brute_base(text):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            doubled = [d * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            fine = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_op2_base_spans(spark, sf_dir, duck):
    texts = dict(_documents(duck))
    rows = queries.op2_privacy(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in ("email", "ip", "card", "phone")] == want
        runs = [m for m in re.finditer("(?<![A-Za-z0-9])[A-Za-z0-9]{16,}", texts[r.doc_id] or "") if min(len(re.findall(c, m[0])) for c in ("[0-9]", "[A-Za-z]")) > 1]
        assert [s for s in spans if s.startswith("secret")] == [f"secret:{m.start()}:{m.end()}" for m in runs] and r.n_secret == len(runs)
        assert r.personal == bool(spans)
        assert r.n_email == sum(s.startswith("email") for s in want)


def test_op4_is_right_on_held_out_rows(spark, sf_dir, duck):
    labels = dict(duck.sql("select doc_id, quality from labels").fetchall())
    rows = queries.op4_quality(spark, sf_dir).collect()
    held = [r for r in rows if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_op5_shards(spark, sf_dir, duck):
    sizes = {d: len((t or "").encode()) + 8 for d, t in _documents(duck)}
    crcs = {d: zlib.crc32((t or "").encode()) for d, t in _documents(duck)}
    rows = queries.op5_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (sizes[d], crcs[d]) for d in sizes}
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(by) <= set(range(24))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    share, largest = sum(sizes.values()) / 24, max(sizes.values())
    assert all(abs(sum(r["size"] for r in by.get(k, [])) - share) <= largest + 0.02 * share for k in range(24))


def test_op6_counts(spark, sf_dir, duck):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        pieces = set(wordpiece.read_vocabulary(f.read()))
    longest, known = max(map(len, pieces)), {}

    def brute(word):
        if word not in known:
            n = at = 0
            while at < len(word):
                at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces)
                n += 1
            known[word] = n
        return known[word]

    rows = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op6_token_counts(spark, sf_dir).collect()}
    for doc, text in _documents(duck):
        words = (text or "").encode().split()
        assert rows[doc] == (len(words), sum(brute(b" " + w) for w in words))


def test_op9_equals_the_library(spark, sf_dir, duck):
    import tiktoken

    from loomgraph.llm.bpe import Ranks

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=Ranks(f.read()).encoder, special_tokens={})
    rows = {r.doc_id: r for r in queries.op9_byte_bpe(spark, sf_dir).collect()}
    for doc, text in _documents(duck):
        ids = own.encode_ordinary(text or "")
        assert rows[doc].n_tokens == len(ids)
        assert rows[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op10_gives_the_articles(spark, sf_dir, duck):
    import html

    def article(source):
        m = re.search(r"<article>(.*?)(</article>|\Z)", source or "", re.S)
        inner = re.sub(r"</?b>", "", m[1] if m else "")
        return " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", inner)).split())

    want = {p: article(h) for p, h in duck.sql("select page_id, html from pages").fetchall()}
    rows = queries.op10_main_text(spark, sf_dir).collect()
    assert len(rows) == len(want)
    assert np.mean([r.text == want[r.page_id] for r in rows]) > 0.98
    assert all(r.n_chars == len(r.text) for r in rows)


def test_op3_deletes_every_repeated_run_but_its_first_place(spark, sf_dir, duck):
    first, gone, texts = {}, {}, {d: t for d, t in _documents(duck) if t is not None}
    for d in sorted(texts):
        lines = [(p, line) for p, line in enumerate(texts[d].split("\n")) if line.strip(" \t\n\v\f\r")]
        for a in range(len(lines)):
            words, run = 0, hashlib.md5()
            for b in range(a, len(lines)):
                words += len(lines[b][1].split())
                run.update(lines[b][1].encode() + b"\n")
                if words >= 50 and first.setdefault(run.digest(), (d, a)) != (d, a):
                    gone.setdefault(d, set()).update(p for p, _ in lines[a : b + 1])
    rows = {r.doc_id: r for r in queries.op3_line_dedup(spark, sf_dir).collect()}
    assert {d: r.n_removed for d, r in rows.items() if r.n_removed} == {d: len(g) for d, g in gone.items()}
    for d, text in texts.items():
        kept = "\n".join(line for p, line in enumerate(text.split("\n")) if p not in gone.get(d, ()))
        assert rows[d].kept_md5 == hashlib.md5(kept.encode()).hexdigest()
