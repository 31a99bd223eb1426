"""Every query of the subpackage over the small tables: its columns and types, against plain versions."""

import hashlib
import itertools
import re
import zlib
from base64 import b64decode
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandline.llm import queries, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=lambda r: r[0])


def result(spark, name, types):
    """The query's rows, once its contract's columns come first and have these types."""
    df = queries.QUERIES[name](spark, SF)
    got = dict(df.dtypes)
    assert all(got[c] == t for c, t in types.items())
    return df.collect()


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def plain_bpe():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_quality(spark, docs):
    rows = queries.QUERIES["op1_quality"](spark, SF).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == [d for d, *_ in docs]
    known = [r.keep == (label[r.doc_id] == 1) for r in rows if label.get(r.doc_id) is not None]
    assert sum(known) >= 0.9 * len(known)


def test_token_files(spark, docs):
    tokenizer, want, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    for d, text, _ in docs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    rows = result(spark, "op2_token_files", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_source_mix(spark, docs):
    types = {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    rows = {r.doc_id: r for r in result(spark, "op3_source_mix", types)}
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight, target, left, fixed = {s: k % 3 + 1 for k, s in enumerate(order)}, {}, sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in fixed]
        target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            fixed.add(s)
    taken, largest = Counter(), 0
    for d, text, source in docs:
        r, n = rows[d], len(WORD.findall(text))
        assert (r.size, r.source_size) == (n, sizes[source]) and r.target == pytest.approx(target[source]) and r.taken <= 3 * n
        taken[source] += r.taken
        largest = max(largest, n)
    assert all(abs(taken[s] - target[s]) <= largest for s in order) and len(rows) == len(docs)


def test_byte_bpe(spark, docs):
    plain = plain_bpe()
    rows = result(spark, "op4_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows}
    for d, text, _ in docs:
        ids = plain.encode_ordinary(text)
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_warc(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op5_warc"](spark, SF).collect()
    assert Counter((r.page_id, r.record_type) for r in rows) == Counter((p, t) for p in pages for t in ("metadata", "conversion"))
    refers = {}
    for r in rows:
        assert r.target_uri == pages[r.page_id].url and r.content_length == len(r.block.encode()) and r.refers_to and r.record_id != r.refers_to
        refers.setdefault(r.page_id, set()).add((r.refers_to, r.source_digest))
        if r.record_type == "conversion":
            title = warc.title(pages[r.page_id].html or "").strip()
            assert not re.search("<(p|div|html|a)[ >]", r.block) and (not title or r.block.startswith(title))
    assert all(len(v) == 1 for v in refers.values()) and len(set.union(*refers.values())) == len(pages)


def test_surrogates(spark, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op6_surrogates"](spark, SF).collect()}
    mail, changed = re.compile(r"[\w.+-]+@[\w-]+\.\w+"), 0
    of = {}
    for d, text, _ in docs:
        r = rows[d]
        before, after = mail.findall(text), mail.findall(r.text or "")
        assert len(before) == len(after) and not set(before) & set(after)
        assert r.n_replaced > 0 or (r.text or "") == text
        for a, b in zip(before, after):
            assert of.setdefault(a.lower(), b.lower()) == b.lower()
            changed += 1
    assert changed and len(set(of.values())) == len(of) and len(rows) == len(docs)


def test_hnsw(spark):
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = result(spark, "op7_hnsw", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    found, hits = {}, 0
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r.score == pytest.approx(np.linalg.norm(x[r.query_id] - x[r.vec_id]), abs=1e-12)
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(found) == {k for k in x if k % 100 == 0}
    for q, got in found.items():
        best = sorted((np.linalg.norm(x[q] - v), k) for k, v in x.items() if k != q)[:10]
        assert len(got) == 10 and got == sorted(got)
        hits += len({k for _, k in got} & {k for _, k in best})
    assert hits >= 0.9 * 10 * len(found)


def test_audio(spark, docs):
    types = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    rows = {r.doc_id: r for r in result(spark, "op8_audio", types)}
    same = {}
    for d, text, _ in docs:
        raw, r = text.encode(), rows[d]
        p = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_bytes >= len(p) and same.setdefault(text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len(rows) == len(docs)


def test_shingle_join(spark, docs):
    sets = []
    for d, text, _ in docs:
        w = words(text)
        sets.append((d, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    low = {d: d for d, _ in sets}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y) and low[a] != low[b]:
            keep, gone = sorted((low[a], low[b]))
            low = {d: keep if c == gone else c for d, c in low.items()}
    rows = result(spark, "op9_shingle_join", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"})
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(d, len(s), low[d]) for d, s in sets]


def test_lm(spark, docs):
    tokens = [(d, zlib.crc32(str(d).encode()) % 5 == 1, [*words(text), None]) for d, text, _ in docs]
    c = Counter(w for _, held, t in tokens if not held for w in t)
    n, v = sum(c.values()), len(c)
    types = {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    rows = {r.doc_id: r for r in result(spark, "op10_gru_lm", types)}
    for d, held, t in tokens:
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    out = [r for r in rows.values() if r.held_out]
    assert len(rows) == len(docs) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]
    got = rows.collect()
    plain = plain_bpe()
    assert {r.doc_id for r in got} <= {d for d, *_ in docs} and max(Counter(r.doc_id for r in got).values()) <= 3
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == plain.encode_ordinary(r.text or "") for r in got)
