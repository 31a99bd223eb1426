"""The operators on small tables with awkward rows, against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandline.llm import audio, bpe, common, gru, hnsw, lm, mixing, quality, shingle_join, surrogates, tokenfiles, warc

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    sets, parent = [(d, shingles(t)) for d, t in docs], list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(b)] = root(a)
    low = {}
    for k, (d, _) in enumerate(sets):
        low[root(k)] = min(low.get(root(k), d), d)
    return sorted((d, len(s), low[root(k)]) for k, (d, s) in enumerate(sets))


@pytest.mark.parametrize("keys", [500_000, 0])
def test_shingle_join(spark, awkward, empty, monkeypatch, keys):
    monkeypatch.setattr(shingle_join, "BROADCAST_KEYS", keys)  # 0: by the bit table
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.link(awkward).collect())
    assert got == components(docs)
    if keys:
        assert shingle_join.link(empty).count() == 0


def test_near_copies_against_brute_force(spark):
    import random

    r, base = random.Random(5), [f"w{k}" for k in range(80)]
    docs = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        docs.append((k, " ".join(w[: 80 - r.randrange(6)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in shingle_join.link(df).collect()) == components(docs)


@pytest.mark.parametrize(("long", "each"), [(32, 1_000_000), (4, 1_000_000), (2, 40)])
def test_every_link_of_a_group(spark, monkeypatch, long, each):
    monkeypatch.setattr(shingle_join, "LONG", long)  # postings from there on make crowds
    monkeypatch.setattr(shingle_join, "CROWD_BLOCK", 7)  # crowds in several blocks
    monkeypatch.setattr(shingle_join, "POSTINGS_EACH", each)  # hot shingles over several buckets
    base = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join([*base[: 60 - k % 20], f"x{k}"])) for k in range(40)] + [(90, " ".join(base)), (91, " ".join(base))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets = {d: shingles(t) for d, t in docs if d != 91}
    want = Counter()
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            want.update((a, b))
    got = shingle_join.link(df).collect()
    assert {r.doc_id: r.n_links for r in got} == {**{d: want[d] for d in sets}, 91: want[90]}
    assert shingle_join.pairs(df).count() == sum(want.values()) / 2


@pytest.mark.parametrize("each", [1_000_000, 40])
def test_short_texts_around_a_common_line(spark, monkeypatch, each):
    """Texts that share a long line but don't link make no crowd, whether its postings are one bucket or several."""
    monkeypatch.setattr(shingle_join, "LONG", 8)
    monkeypatch.setattr(shingle_join, "POSTINGS_EACH", each)
    line = [f"w{k}" for k in range(60)]
    own = lambda d, n: [f"d{d}x{k}" for k in range(n)]
    docs = [(k, " ".join([*line, *own(k, 15)])) for k in range(100)] + [(200 + k, " ".join([*line, *own(k, 14), "z"])) for k in range(0, 100, 7)]
    docs += [(400 + k, " ".join([*line[: 50 + k], *own(k, 22)])) for k in range(9)] + [(500 + k, " ".join([*line, *own(500 + k, 4)])) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    sets, want = {d: shingles(t) for d, t in docs}, Counter()
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            want.update((a, b))
    assert {r.doc_id: r.n_links for r in shingle_join.link(df).collect()} == {d: want[d] for d in sets}
    apart = df.filter("doc_id < 100")
    members, counts = shingle_join.survey(apart)
    assert shingle_join.crowds(shingle_join.candidates(apart, counts, 8, 75)[1], 75).count() == 0
    linked = df.filter("doc_id >= 500")
    members, counts = shingle_join.survey(linked)
    assert shingle_join.crowds(shingle_join.candidates(linked, counts, 8, 75)[1], 75).count() == 12


def test_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 90)).astype("<u8")) for _ in range(60)] + [np.arange(20, dtype="<u8")] * 3
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (shingle_join.intersections(sets, None) == want).all()
    assert (shingle_join.intersections(sets[:20], sets[20:]) == np.array(want)[:20, 20:]).all()


def test_bpe_equals_tiktoken(spark, awkward, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    e = bpe.encoder(path, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(awkward, path, P.PATTERN), path, P.PATTERN).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ref.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(empty, path, P.PATTERN).count() == 0
    for t in ("a   b", " \n x", "x  ", "'s　 9", "<|endoftext|>", "é\x85 \xa0z"):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ref.encode_ordinary(t)


def test_token_files(spark, awkward, empty):
    path = P.path("byte_bpe_50k.json")
    e = tokenfiles.encoder(path)
    manifest = tokenfiles.write(awkward, common.scratch_path(spark, "t"), path, shards=3)
    got = sorted(((r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in tokenfiles.read(manifest).collect()), key=lambda x: x[1])
    at = 0
    for (key, start, ids), r in zip(got, sorted(awkward.collect(), key=lambda r: r.doc_id)):
        assert (key, start) == (r.doc_id, at)
        if r.doc_id != 11:
            assert ids == e.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        at += len(ids)
    assert tokenfiles.read(tokenfiles.write(empty, common.scratch_path(spark, "t"), path)).count() == 0


def test_mix(spark, awkward, empty):
    rows = mixing.mix(mixing.sized(awkward)).collect()
    assert len(rows) == awkward.count() and all(r.size == len(re.findall(common.WORD, r.text or "")) and r.taken <= 3 * r.size for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - sum(r.size for r in rows)) < 1e-6 and all(t <= 3 * s for t, s in targets.values())
    assert mixing.mix(mixing.sized(empty)).count() == 0
    clash = {c: F.lit(f"{c}!") for c in ("base", "key", "bucket", "b", "s", "source_rows", "n1", "n10", "kept", "weight", "fill")}
    wide = mixing.mix(mixing.sized(awkward.withColumns(clash)))
    assert wide.columns == [*awkward.columns, *[c for c in clash if c not in awkward.columns], "size", "level", "source_size", "target", "times", "taken"]
    assert {tuple(r[c] for c in clash) for r in wide.collect()} == {tuple(f"{c}!" for c in clash)}
    assert sorted((r.doc_id, r.taken) for r in wide.collect()) == sorted((r.doc_id, r.taken) for r in rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = mixing.mix(mixing.sized(docs)).groupBy("source", "target").sum("taken").collect()
    most = max(r.size for r in mixing.sized(docs).collect())
    assert all(abs(r["sum(taken)"] - r.target) <= most for r in near)


def test_surrogates(spark, awkward, empty):
    rows = {r.doc_id: r for r in surrogates.replace(awkward, key="k").collect() if r.doc_id != 11}
    t = rows[12].text
    assert rows[12].n_replaced == 3 and "a.b@x.org" not in t.lower() and "4111111111111111" not in t and t.endswith("é　日本 😀")
    a, b = re.findall(r"\S+@\S+\.\w+", t)
    assert a.lower() == b.lower() and a != b and rows[3].text is None and rows[6].text == "one two"
    assert surrogates.replace(empty).count() == 0


def test_surrogates_stay_distinct(spark):
    ips = [(k, f"host 1.1.1.{k} and +1 (017) 555-77{k:02d}") for k in range(10)]
    rows = surrogates.replace(spark.createDataFrame(ips, "doc_id long, text string"), key="k").collect()
    found = [re.search(r"host (\S+) and (.*)", r.text).groups() for r in rows]
    assert len({f[1] for f in found}) == 10 and len({f[0] for f in found}) == 10
    assert not {f[0] for f in found} & {f"1.1.1.{k}" for k in range(10)}


def test_a_full_format_keeps_surrogates_distinct(spark):
    ips = [(k, "host {}.{}.{}.{}".format(*f"{k:04d}")) for k in range(6000)] + [(7000, "password=!!!!!!!! end")]
    rows = {r.doc_id: r.text for r in surrogates.replace(spark.createDataFrame(ips, "doc_id long, text string"), key="k").collect()}
    assert rows.pop(7000) == "password=xxxxxxxx end"
    assert len(set(rows.values())) == 6000 and all(re.fullmatch(r"host \d\.\d\.\d\.\d", t) for t in rows.values())
    assert all(rows[k] != t for k, t in ips[:6000])


def test_a_name_has_one_surrogate_whatever_its_title(spark):
    df = spark.createDataFrame([(1, "Dr. Anna Smith came, Mrs. Anna Smith spoke, Anna Smith and Smith stayed")], "doc_id long, text string")
    m = re.fullmatch(r"Dr\. (\w+) (\w+) came, Mrs\. (\w+) (\w+) spoke, (\w+) (\w+) and (\w+) stayed", surrogates.replace(df, key="k").first().text)
    assert m and m[1] == m[3] == m[5] != "Anna" and m[2] == m[4] == m[6] == m[7] != "Smith"


def test_names_keep_gender_and_surname(spark):
    df = spark.createDataFrame([(1, "Mr. John Smith met Mrs. Anna Smith and Frau Weber.")], "doc_id long, text string")
    t = surrogates.replace(df, key="k").first().text
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Frau (\w+)\.", t)
    assert m and m[2] == m[4] != "Smith" and m[1] != "John" and m[5] not in ("Weber", m[2])


def test_long_secrets_and_bare_names(spark):
    long = "Ab1-" * 50
    texts = [f'token="{long}" end', "sk-" + "a1B2" * 40 + " end", "0123456789abcdef" * 8 + " end", "password=correct-horse end", "Dr Anna Weber came. Then Weber said: Anna's here, WEBER-Haus; weber Webers"]
    rows = surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").collect()
    got = {r.doc_id: r for r in rows}
    assert re.fullmatch(r'token="([A-Z][a-z][0-9]-){50}" end', got[0].text) and long[-8:] not in got[0].text
    assert re.fullmatch(r"sk-\w{160} end", got[1].text) and "a1B2a1B2" not in got[1].text
    assert re.fullmatch(r"[0-9a-f]{128} end", got[2].text) and "89abcdef" not in got[2].text
    assert re.fullmatch(r"password=[a-z]{7}-[a-z]{5} end", got[3].text) and "horse" not in got[3].text
    m = re.fullmatch(r"Dr (\w+) (\w+) came\. Then (\w+) said: (\w+)'s here, (\w+)-Haus; weber Webers", got[4].text)
    assert m and m[2] == m[3] != "Weber" and m[1] == m[4] != "Anna" and m[5] == m[2].upper()
    assert got[4].n_replaced == 4


def test_quality(spark, awkward, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(quality.features(docs, labels))
    got = quality.score(quality.features(docs, labels), model).join(labels, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) >= 0.95 * len(got)
    kept = quality.screen(awkward, model)
    assert kept.columns == awkward.columns and kept.count() <= awkward.count()
    none = quality.features(awkward, labels.limit(0))
    assert all(r.keep for r in quality.score(none, quality.train(none)).collect())
    assert quality.score(quality.features(empty, labels), model).count() == 0


def test_lm(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    tokens = [(d, words(t) + [None]) for d, t in rows]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in tokens if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((d, held(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for d, t in tokens)
    got = lm.score(awkward).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(empty).count() == 0


def test_lm_learns_from_every_training_token(spark, awkward, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 1000)  # several tasks and rounds
    trained = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: trained.append(fit(*a)) or trained[-1])
    rows = lm.score(awkward).collect()
    assert trained[0][1] == rows[0].train_tokens == sum(r.n_tokens for r in rows if not r.held_out)
    assert lm.head_size(5_000_000_000) > 4 * lm.head_size(1_000_000)


def test_lm_states_are_as_many_as_the_tokens_make(spark, monkeypatch):
    """Rows that are averaged come from the tasks of the tokens, however many partitions a shuffle by a key has."""
    monkeypatch.setattr(lm, "TASK_TOKENS", 40_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_key = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *cols: by_key(self, max(n, 40) if cols and isinstance(n, int) else n, *cols))
    made, added = [], lm.sums.added
    monkeypatch.setattr(lm.sums, "added", lambda parts: made.append(parts.filter("name = 'tokens'").count()) or added(parts))
    n = lm.score(docs).first().train_tokens
    tasks, rounds = lm._tasks(n)
    assert len(made) == rounds > 1 and max(made) <= tasks


def test_gru_probabilities_sum_to_one():
    n = 150
    w = gru.fresh(n, np.arange(n, 0, -1).astype(float))
    h = np.random.default_rng(0).normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    assert abs(np.exp(gru.log_probs(w, np.repeat(h, n, 0), np.arange(n))).sum() - 1) < 1e-4


def plain_gru(w, doc):
    """Natural log probability of a document, symbol by symbol in double precision."""
    w = {k: v.astype(float) for k, v in w.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, size, h, x, total = len(w["embed"]), gru.HIDDEN, np.zeros(gru.HIDDEN), 0, 0.0
    for y in doc:
        a, u = w["embed"][x] @ w["inp"] + w["bias"], h @ w["rec"]
        z, r = sig(a[:size] + u[:size]), sig(a[size : 2 * size] + u[size : 2 * size])
        new = np.tanh(a[2 * size :] + r * u[2 * size :])
        h = (1 - z) * new + z * h
        c, k = (0, 0) if y == n - 1 else (1 + y // gru.WIDTH, y % gru.WIDTH)
        parts = [(h @ w["cls"] + w["cls_b"], c)] + ([(h @ w["out"][c] + w["out_b"][c], k)] if c else [])
        total += sum(q[j] - np.log(np.exp(q).sum()) for q, j in parts)
        x = y
    return total


def test_gru_against_a_plain_one():
    rng, n = np.random.default_rng(2), 150
    docs = [np.append(rng.integers(1, n, k), 0).astype("<i4") for k in (0, 1, 5, 40, 200)]
    w = gru.train(docs, n, np.ones(n), 3)
    assert np.allclose(gru.score(w, docs, 3, 16), [plain_gru(w, d) for d in docs], rtol=1e-4)


def test_gru_gradient():
    rng, n = np.random.default_rng(3), 90
    w = gru.fresh(n, np.ones(n))
    w = {k: (v * 2 if k in ("cls", "out", "rec") else v) for k, v in w.items()}
    docs = [np.append(rng.integers(1, n, k), 0).astype("<i4") for k in (6, 9)]
    (x, y, first, of), *more = gru.streams(docs, 2, 32)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    gru._gradients(w, g, x, y, first, np.zeros((2, gru.HIDDEN), np.float32), of >= 0)
    assert not more
    loss = lambda v: -sum(plain_gru(v, d) for d in docs) / sum(map(len, docs))
    for name, value in w.items():
        for at in rng.choice(np.flatnonzero(np.abs(g[name]).ravel() > 1e-4), 5):
            shifted = []
            for step in (1e-4, -1e-4):
                v = {k: a.astype(float) for k, a in w.items()}
                v[name].ravel()[at] += step
                shifted.append(loss(v))
            assert abs((shifted[0] - shifted[1]) / 2e-4 - g[name].ravel()[at]) < 1e-3 * max(0.05, np.abs(g[name]).max()), name


def test_lm_beats_the_base_on_held_out_texts(spark):
    import random

    r = random.Random(8)
    follow = {k: [r.randrange(300) for _ in range(3)] for k in range(300)}

    def text():
        k, out = r.randrange(300), []
        for _ in range(120):
            out.append(f"w{k}")
            k = r.choice(follow[k])
        return " ".join(out)

    docs = spark.createDataFrame([(k, text()) for k in range(700)], "doc_id long, text string")
    rows = [x for x in lm.score(docs).collect() if x.held_out]
    assert sum(x.score for x in rows) > sum(x.base_score for x in rows) * 0.9


def test_gru_state_is_carried():
    docs = [np.array([3, 5, 7, 9, 0] * 40), np.array([2, 0])]
    w = gru.train(docs, 20, np.ones(20))
    assert np.allclose(gru.score(w, docs, 1, 7), gru.score(w, docs, 2, 500), rtol=1e-4)


def test_gru_takes_exponentials_of_many_classes_at_once(monkeypatch):
    """A class has few rows of a window, so calls go by rows, not by classes."""
    rng, n, calls = np.random.default_rng(5), 40 * gru.WIDTH, []
    docs = [np.append(rng.integers(1, n, 60), 0).astype("<i4") for _ in range(30)]
    plain = gru._exp
    monkeypatch.setattr(gru, "_exp", lambda *a: calls.append(len(a[0])) or plain(*a))
    w = gru.fresh(n, np.ones(n))
    (x, y, first, of), *_ = gru.streams(docs, 16, 32)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    gru._gradients(w, g, x, y, first, np.zeros((16, gru.HIDDEN), np.float32), of >= 0)
    pieces = -(-y.size // gru.ROWS)
    assert 0 < len(calls) <= 2 * pieces
    calls.clear()
    got = gru.score(w, docs)
    assert 0 < len(calls) <= 2 * -(-sum(map(len, docs)) // gru.ROWS)
    assert np.allclose(got, [plain_gru(w, d) for d in docs], rtol=1e-4)


@pytest.mark.parametrize("rows", [7, 768])
@pytest.mark.parametrize("scale", [1, 40])
def test_gru_of_large_weights_and_small_pieces(monkeypatch, rows, scale):
    """Gates that are 0 or 1, outputs whose exponentials would overflow, and classes that lie across pieces."""
    monkeypatch.setattr(gru, "ROWS", rows)
    rng, n = np.random.default_rng(6), 150
    w = {k: v * np.float32(scale) for k, v in gru.fresh(n, np.ones(n)).items()}
    w["out_b"] /= np.float32(scale)
    docs = [np.append(rng.integers(1, n, k), 0).astype("<i4") for k in (0, 3, 90)]
    with np.errstate(all="raise", under="ignore"):
        got = gru.score(w, docs, 2, 16)
    assert np.allclose(got, [plain_gru(w, d) for d in docs], rtol=1e-3)
    (x, y, first, of), *_ = gru.streams(docs, 2, 96)
    both = []
    for size in (rows, 10_000):
        monkeypatch.setattr(gru, "ROWS", size)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        gru._gradients(w, g, x, y, first, np.zeros((2, gru.HIDDEN), np.float32), of >= 0)
        both.append(g)
    assert all(np.isfinite(v).all() and np.allclose(v, both[1][k], atol=1e-5 * max(1, np.abs(v).max())) for k, v in both[0].items())


@pytest.mark.parametrize("kind", ["binary", "large_binary"])
def test_lm_words_of_all_texts_at_once(kind):
    """The same words as of one text after another, for bytes of every sort, without a step of Python a word."""
    import random

    import pyarrow as pa

    r = random.Random(1)
    some = [b" ", b"\t", b"\x0b", b"\x0c", b"\r\n", b"\x1c", b"\x85", b"\xa0", b"\xc3\x89", b"\xe2\x80\x83", b"\xff", b"\x00", b"A", b"z", b"Z[@"]
    for _ in range(100):
        texts = [None if r.random() < 0.1 else b"".join(r.choices(some, k=r.randrange(12))) for _ in range(r.randrange(9))]
        k = r.randrange(3)
        found, n = lm.all_words(pa.array(texts, getattr(pa, kind)()).slice(k))
        want = [lm.words_of(t) for t in texts[k:]]
        assert n.tolist() == list(map(len, want)) and found.to_pylist() == sum(want, [])
        assert lm._bytes_of(found.dictionary_encode().dictionary) == list(dict.fromkeys(sum(want, [])))


def test_lm_of_documents_without_words(spark):
    rows = lm.score(spark.createDataFrame([(k, t) for k, t in enumerate([None, "", " \n", "\t"] * 5)], "doc_id long, text string")).collect()
    assert len(rows) == 20 and all(r.n_tokens == 1 and np.isfinite(r.score) for r in rows)


@pytest.mark.parametrize(("each", "spread"), [(4096, 1.0), (300, 1.0), (300, 0.05)])
def test_nearest_against_brute_force(spark, monkeypatch, each, spread):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", each)  # 300: at least ten shards
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(6, 8))[rng.integers(0, 6, 3000)] * 3 + spread * rng.normal(size=(3000, 8))).astype("<f4")
    x[5:40] = x[4]
    rows = [(k, x[k].tolist()) for k in range(len(x))] + [(9000, None), (9100, [0.0] * 8), (9200, [float("nan")] * 8), (9300, [1.0, None] * 4), (0, x[0].tolist())]
    v = hnsw.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    index = hnsw.build(v, 10)
    assert (index[0].count() >= 10) == (each == 300) and index[0].agg({"rows": "sum"}).first()[0] == 2965
    got = hnsw.nearest(index, v.filter("vec_id % 100 = 0 or vec_id = 7"), 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [k for k in np.lexsort((np.arange(len(x)), d)) if k != q][:10]
        hits += len({f[1] for f in found} & set(best))
        assert [f[0] for f in sorted(found)] == list(range(1, 11)) and all(abs(d[f[1]] - f[2]) < 1e-12 for f in found)
    assert len(by) == 31 and hits >= 0.9 * 10 * len(by)
    assert hnsw.nearest(hnsw.build(v.limit(0), 10), v.limit(0), 10).count() == 0


def test_nearest_among_vectors_of_several_lengths(spark):
    rows = [(k, [float(k), 1.0]) for k in range(30)] + [(100 + k, [1.0] * (3 + k)) for k in range(3)] + [(200, [1.0] * 3), (201, [2.0] * 3)]
    v = hnsw.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("c")).withColumn("ids", F.lit("i")))
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in hnsw.nearest(hnsw.build(v, 2), v.filter("vec_id in (0, 100, 101)"), 2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 2.0), (100, 1, 200, 0.0), (100, 2, 201, round(3**0.5, 6))]


def test_audio(spark, awkward, empty):
    media = audio.store(awkward)
    stored = audio.analysed(media)
    got = {r.doc_id: r for r in audio.digests(stored).collect()}
    for r in awkward.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[6].feature == got[7].feature and len(got) == 12
    for r in stored.collect():
        mels, tiles = audio.opened(bytes(r.tensors))
        assert mels.shape == (sum(f for *_, f in tiles), audio.MELS) and got[r.doc_id].feature == audio.summary(mels, tiles)
    assert audio.digests(audio.analysed(audio.store(empty))).count() == 0


def test_audio_against_plain_versions():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.3, 3001).astype(np.float32)
    n, h = audio.UP * audio.TAPS, audio._phases().T.ravel().astype(float)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    direct = np.convolve(up, h)[:: audio.DOWN][: -(-len(x) * audio.UP // audio.DOWN)]
    assert len(h) == n and audio.UP > 1 and np.allclose(audio.resampled(x), direct, atol=1e-5)

    got, rate = audio.logmel(x), audio.RATE * audio.UP / audio.DOWN
    at = np.arange(audio.FFT // 2 + 1) * rate / audio.FFT
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), audio.MELS + 2) / 2595) - 1)
    for k in (0, 7, len(got) - 2):
        frame = x[k * audio.HOP :][: audio.FRAME] * np.hanning(audio.FRAME)
        power = np.abs(np.array([np.sum(frame * np.exp(-2j * np.pi * f * np.arange(audio.FRAME) / audio.FFT)) for f in range(len(at))])) ** 2
        bands = [np.sum(power * np.interp(at, edges[m : m + 3], [0, 1, 0])) for m in range(audio.MELS)]
        want = (np.log(np.array(bands) + 1e-6) - audio.LOWEST) / audio.STEP
        assert np.abs(got[k] - want).max() <= 0.51

    mels = rng.integers(0, 200, (400, audio.MELS)).astype(np.uint8)
    energy = mels.sum(1, dtype=int)
    ranked, open_, found = np.sort(energy), None, []
    high, low = ranked[int(audio.UPPER * 400)], ranked[int(audio.LOWER * 400)]
    for k, e in enumerate(energy):
        if open_ is None and e >= high:
            open_ = k
        elif open_ is not None and e < low:
            found.append((open_, k))
            open_ = None
    assert audio.segments(mels) == found + ([(open_, 400)] if open_ is not None else [])


def test_warc(spark):
    page = '<html lang="en"><title>A &amp; B</title><script>x="</p>"</script><p>One<b>two</b></p><!-- no --><a href="/l">Link</a></html>'
    pages = spark.createDataFrame([(1, "http://a/x", page), (1, "http://a/x", page), (2, None, None)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(pages))
    back = warc.read(warc.write(made, common.scratch_path(spark, "warc"))).collect()
    assert len(back) == 6
    texts = {r.page_id: bytes(r.block).decode() for r in back if r.headers["WARC-Type"] == "conversion"}
    assert texts == {1: "A & B\nOnetwo\nLink", 2: ""}
    source = {r.page_id: r.headers for r in warc.responses(pages).collect()}
    for r in back:
        assert r.headers["WARC-Refers-To"] == source[r.page_id]["WARC-Record-ID"] and r.headers["WARC-Source-Payload-Digest"] == source[r.page_id]["WARC-Payload-Digest"]
        assert r.headers.get("WARC-Target-URI") == source[r.page_id].get("WARC-Target-URI")
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_warc_reads_any_page_in_linear_time():
    import time

    page = '<HTML lang="de"><title>A <b>b</b> &amp; c</title><a class=x href="/one">1</a><a href=\'/t>wo\' x>2</a><p>Hi <br>there <a'
    assert (warc.title(page), warc.language(page), warc.links(page)) == ("A b & c", "de", ["/one", "/t>wo"])
    assert warc.plain(page).splitlines()[-1].strip() == "there <a"
    began = time.time()
    for piece in ("<a", "<title>", "<html ", "<a href=", "<p", "<script", "<!-", "<a href=' ", "<title", "</title"):
        big = piece * (2_000_000 // len(piece))
        for text in (big, big + ">"):
            warc.plain(text), warc.title(text), warc.language(text), warc.links(text)
    assert time.time() - began < 60


def test_warc_files_by_a_plain_parser(spark):
    import gzip

    rows = [(1, "http://a.org/x", "<title>T</title>Text"), (2, None, None), (3, "http://b.org", "&#x110000; &bad; \ud7ff <a href=/l>l</a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("headers", F.lit("h")).withColumn("block", F.lit("b"))
    files = warc.write(warc.derive(warc.responses(pages)), common.scratch_path(spark, "warc-test")).collect()
    seen = []
    for f in files:
        with gzip.open(f.path) as z:
            data = z.read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            seen.append((fields[b"X-Page-ID"], fields[b"WARC-Type"], fields.get(b"WARC-Target-URI"), rest[:size]))
            data = rest[size + 4 :]
    assert sorted((p, t) for p, t, _, _ in seen) == sorted((str(k).encode(), t) for k in (1, 2, 3) for t in (b"conversion", b"metadata"))
    assert (b"1", b"conversion", b"http://a.org/x", b"T\nText") in seen or (b"1", b"conversion", b"http://a.org/x", b"TText") in seen
    assert any(p == b"3" and b"outlink: /l\r\n" in x for p, _, _, x in seen)


def test_pipeline(spark, awkward):
    import corpus_pipeline as c

    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    kept = c.drop_near_duplicates(spark, docs, SF).collect()
    want = {d for d, _, low in components([(r.doc_id, r.text) for r in docs.collect()]) if d == low}
    assert sorted(r.doc_id for r in kept) == sorted(want)
    for name, stage in c.STAGES[:-1]:
        docs = common.written(stage(spark, docs, "/root/testdata/sf0.01"), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    last = c.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_pipeline_keeps_columns_and_takes_empty_tables(spark, awkward):
    import corpus_pipeline as c

    extra = {k: F.lit(f"{k}!") for k in ("base", "key", "size", "level", "times", "taken", "target", "n_replaced", "row", "id", "sid", "component_id", "score", "keep", "view", "y")}
    null = awkward.limit(1).select(*[F.lit(None).cast(t).alias(n) for n, t in awkward.dtypes])
    for docs in (awkward.unionByName(null).select("doc_id", "text", "lang", "source", "n_chars").withColumns(extra), awkward.limit(0).withColumns(extra)):
        columns = docs.columns
        for name, stage in c.STAGES[:-1]:
            docs = common.written(stage(spark, docs, "/root/testdata/sf0.01"), name)
            assert docs.columns == columns, name
            assert all(r[k] == f"{k}!" for r in docs.collect() for k in extra), name
        assert c.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_duplicates_are_decided_by_row(spark):
    import corpus_pipeline as c

    a, b, d, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abde")
    rows = [(None, a), (None, b), (None, d), (None, d), (3, a), (7, b + " more"), (7, e), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in c.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(3, a), (7, b + " more"), (None, d), (7, e), (8, None), (8, None)], key=str)


def test_personal_data_to_the_end_of_its_token(spark):
    from strandline.llm import surrogates

    gone = {
        'password="correct horse battery staple" x': ["correct", "horse", "battery", "staple"],
        "pwd: 'a b7' end": ["b7"], "password=abc12": ["abc12"], "token: ab1": ["ab1"],
        "x" * 70 + "@example.com": ["x" * 70, "example"], "see a@b.c.d.e.f.gg.hh.com now": ["gg.hh.com", "a@b"],
        "addr 2001:0db8:85a3:0000:0000:8a2e:0370:7334, fe80::1ff:fe23:4567:890a": ["2001:0db8", "8a2e", "fe23"],
        "call 030 1234567 or 0171-2345678, 01 23 45 67 89": ["1234567", "2345678", "23 45"], "(030) 1234567": ["1234567"], "+49 (0)30 1234567": ["1234567"],
        "Mr O'Neil's dog. O'Neil's cat, O’Neil ran": ["O'Neil"],
    }
    same = ["on 01.02.2020 12:30 we met", "the secret: love is", "12:34:56 std::vector a::b", "a." * 100_000 + " end"]
    rows = [(k, t, "x", "y") for k, t in enumerate([*gone, *same])]
    df = spark.createDataFrame(rows, "doc_id int, text string, entities__ string, row__ string")
    got = surrogates.replace(df, "k")
    assert got.columns == ["doc_id", "text", "entities__", "row__", "n_replaced"]
    for r in got.collect():
        old = rows[r.doc_id][1]
        assert (r.entities__, r.row__) == ("x", "y")
        if old in gone:
            assert r.n_replaced and len(r.text) >= 5 and not any(x in r.text for x in gone[old]), r
        else:
            assert (r.text, r.n_replaced) == (old, 0)
    name = next(r.text for r in got.collect() if "dog" in r.text)
    assert name.split(" ")[1] == name.split(" ")[3] + "'s" or name.split(" ")[1] == name.split(" ")[3]


def test_a_full_format_goes_round(spark):
    """All ten two-letter, one-digit secrets of a shape: each takes another's value, none its own, none twice."""
    from strandline.llm import surrogates

    norms = spark.createDataFrame([("secret", str(k)) for k in range(10)] + [("secret", "ab1")], "kind string, norm string")
    got = {r.norm: r.surrogate for r in surrogates.assign(norms, "k").collect()}
    assert len(set(got.values())) == 11 and {got[str(k)] for k in range(10)} == {str(k) for k in range(10)} and all(a != b for a, b in got.items())


def test_special_token_strings_as_the_library_has_them():
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    from strandline.llm import tokenfiles

    plain, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokenfiles.encoder(P.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|>b c", "<|endoftext|> <|endoftext|>", "plain text", "x" * 50 + "<|endoftext|>\n", ""]
    got = [list(map(int, x)) for ids, n in own.encode_all(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_without_ids_have_keys_of_their_own(spark):
    from strandline.llm import mixing

    rows = [(None if k % 2 else 7, f"word{k} " * (1 + k % 5), "s") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sized(df)
    keys = sized.select(mixing._uniform(F.col("doc_id"), F.col("mark"), 7).alias("u")).distinct().count()
    got = [mixing.mix(sized, share=0.4).select("text", "taken").collect() for _ in range(2)]
    assert keys == 300 and sorted(got[0]) == sorted(got[1])
    assert abs(sum(r.taken for r in got[0]) - 0.4 * sum(1 + k % 5 for k in range(300))) <= 5


def test_the_model_depends_on_documents_alone(spark, monkeypatch):
    """Other files, partitions and numbers of cores give the same scores, over several tasks and rounds."""
    from strandline.llm import lm

    monkeypatch.setattr(lm, "TASK_TOKENS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = []
    for parts in (1, 5):
        rows = lm.score(docs.repartition(parts)).collect()
        got.append([(r.base_score, r.score) for r in sorted(rows, key=lambda r: r.doc_id)])
    assert len(got[0]) == 200 and np.allclose(got[0], got[1], rtol=1e-6, atol=0)  # 32-bit sums of other batches
