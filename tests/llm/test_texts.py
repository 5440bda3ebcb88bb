"""Operators that take each text on its own: tokens, packing, secrets, languages, mixing."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gateloom.llm import langid, mixing, packing, secrets, tokencount

PIECES = st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "\t", "'s", "don't", "1", "é", "É", "!", ",", '."', " ", "\x1c", "　", "<|endoftext|>", "<|StartOfText|>", "日本", "é", "ß", "😀"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def byte_level():
    return tokencount.load(tokencount.tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return tokencount.load(tokencount.tokenizer_path("word_bpe_49k.json"))


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_counts_and_splices_are_those_of_whole_texts(byte_level, text):
    whole = byte_level.encode(text, add_special_tokens=False).ids
    assert tokencount.counts(byte_level, [text]) == [len(whole)]
    assert tokencount.long_ids(byte_level, text, 12, 3) == whole


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_chunk_ids_are_those_of_whole_texts(word_level, text):
    c = packing.ChunkIds(word_level, most=50)
    for _ in range(2):
        assert c.of([text])[0] == array("I", word_level.encode(text, add_special_tokens=False).ids).tobytes()


def test_no_boundary_anywhere(byte_level):
    for text in ("a" * 4000, " " * 4000, "ab " * 10 + "c" * 3000 + " d"):
        assert tokencount.long_ids(byte_level, text, 300, 8) == byte_level.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, rows, byte_level, empty, nulls):
    got = sorted(map(tuple, tokencount.token_counts(docs, chunk=500, overlap=16).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), n := len(byte_level.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows]
    assert got == sorted(want, key=str)
    assert tokencount.token_counts(empty).count() == 0 and [r["n_tokens"] for r in tokencount.token_counts(nulls).collect()] == [0, 0]


def test_sentencepiece(docs, rows):
    sp = tokencount.load(tokencount.tokenizer_path("piece_bpe_32k.model"))
    got = sorted(r["n_tokens"] for r in tokencount.token_counts(docs, "piece_bpe_32k.model").collect())
    assert got == sorted(len(sp.encode(r[1] or "")) for r in rows)


def test_packing(docs, rows, word_level, empty, nulls):
    got = packing.packed(docs, size=64).collect()
    want = Counter()
    for r in rows:
        ids = [*word_level.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[r[0], k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) <= 1.05 * math.ceil(sum(r["length"] for r in got) / 64) + 1
    assert packing.packed(empty).count() == 0 and packing.packed(nulls).count() == 2


@given(st.lists(st.integers(1, 50), max_size=200))
@settings(max_examples=60, deadline=None)
def test_plans_use_each_length_once(lengths):
    have = np.bincount(lengths, minlength=51)
    out = packing.plan(have, 50)
    used = Counter()
    for p, n in out:
        assert sum(p) <= 50
        for v in p:
            used[v] += n
    assert used == Counter(lengths)
    assert sum(n for _, n in out) <= 1.08 * sum(n for _, n in packing.best_fit(have, 50)) + 1


def test_non_negative_fit():
    """Patterns with one solution each, and one that would need a negative count."""
    found = [(5, 5), (5, 3, 2), (3, 3, 3)]
    a = np.zeros((11, 3))
    for k, p in enumerate(found):
        for v in p:
            a[v, k] += 1
    x = packing.fitted(a @ np.array([3, 4, 2]), found, 10, 4000)
    assert np.allclose(x, [3, 4, 2], atol=1e-3)
    have = a @ np.array([3, 4, -2])
    x = packing.fitted(have, found, 10, 4000)
    grad = a.T @ (a @ x - have)
    assert (x >= 0).all() and x[2] == 0 and np.allclose(grad[x > 1e-6], 0, atol=1e-2) and grad[2] >= -1e-2


def test_patterns_hold_most_sequences():
    rng = np.random.default_rng(1)
    have = np.bincount(np.clip(rng.lognormal(6, 0.9, 30_000).astype(int), 5, 2047), minlength=2049)
    least = -(-int((have * np.arange(2049)).sum()) // 2048)
    found = packing.patterns(have)
    took = packing.rounded(packing.fitted(have, found), found, have)
    assert all(sum(p) <= 2048 and len(p) <= packing.PIECES + 1 for p in found) and sum(n for _, n in took) > 0.7 * least
    assert sum(n for _, n in packing.plan(have)) <= 1.005 * least + 1


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(t):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24], key=lambda x: (x[0], x[2]))


SECRET = st.lists(st.sampled_from(["password", "PassWD", "toKen", "token", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "abc123", "x", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", "\n", "==", "ſecret"]), max_size=30).map("".join)


@given(SECRET)
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    base, spans = secrets.spans_of(text, secrets.Guesser({}))
    assert base == plain_base(text) and set(base) <= set(spans)


def test_guess_costs():
    cheap = ["password123", "qwertyuiop", "2020-01-31", "aaaaaaaa", "changeme", "P@ssw0rd", "abcabcabc"]
    dear = ["x8Kd02Lqpz9Vw", "hT4!kq_9ZrPw", "sk_live_4eC39HqLyjWDarjtT1"]
    assert max(map(secrets.guess_cost, cheap)) < secrets.MIN_LOG10 <= min(map(secrets.guess_cost, dear))
    assert secrets.guess_cost("Zq8") == pytest.approx(3 * math.log10(62)) and secrets.guess_cost("") == 0
    text = "db_pwd: 'x8Kd02Lqpz9Vw', pwd = changeme"
    assert secrets.shown(secrets.spans_of(text, secrets.Guesser({}))[1]) == "guess:9:22"


@given(st.text(st.sampled_from("aAsSd12p4$x9"), min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_guess_costs_against_all_segmentations(value):
    """The programme finds the cheapest of all 2^(n-1) segmentations."""
    if secrets.REFERENCE.fullmatch(value):
        return
    g = secrets.Guesser({"as": 500, "pass": 7, "sad": 40, "dad": 9})
    brute = math.log10(secrets.alphabet(value))
    cost = {(i, i + 1): (brute, False) for i in range(len(value))}
    for a, b, c in g.pieces(value):
        if c + 0.3 < cost.get((a, b), (math.inf, True))[0] or (a, b) not in cost:
            cost[a, b] = (c, True)
    best = math.inf
    for cuts in range(1 << (len(value) - 1)):
        at = [0, *(i + 1 for i in range(len(value) - 1) if cuts >> i & 1), len(value)]
        spans = list(zip(at, at[1:]))
        if all(x in cost for x in spans):
            best = min(best, sum(cost[x][0] + 0.3 * (cost[x][1] and x[0] > 0) for x in spans))
    assert g.cost(value) == pytest.approx(best)
    # the words among the pieces are all those of the dictionary
    low = value.lower()
    words = {(a, b) for a in range(len(value)) for b in range(a + 3, len(value) + 1) if low[a:b] in g.rank}
    assert words <= {(a, b) for a, b, _ in g.pieces(value)}


def test_ordinary_values_are_cheap(spark):
    g = secrets.Guesser({})
    for v in ("international", "configuration", "elephant", "os.environ", "${DB_PASSWORD}", "*" * 200, "<your-token>", "{{secret}}", "changeme123", "Summer2024", "qwertyuiop", "abababababababab"):
        assert g.cost(v) < secrets.MIN_LOG10, (v, g.cost(v))
    for v in ("b7db7aa4a5fcc78305", "Xk3#9vLq!2pZ", "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"):
        assert g.cost(v) >= secrets.MIN_LOG10
    docs = spark.createDataFrame([(1, "token=b7db7aa4a5fcc78305 and password: quokkaquokka " + "quokka wombat " * 50), (2, "wombat quokka " * 9)], "doc_id bigint, text string")
    assert secrets.word_ranks(docs)["quokka"] > len(secrets.WORDS) and "b7db7aa4a5fcc78305" not in secrets.word_ranks(docs)
    got = secrets.secret_spans(docs).first()
    assert (got["n_assign"], got["n_guess"], got["spans"].split(",")[:2]) == (2, 1, ["assign:0:24", "guess:6:24"])


def test_secret_scan(docs, rows, empty, nulls):
    got = sorted(map(tuple, secrets.secret_spans(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=str)
    base = [(r[0], plain_base(r[1] or "")) for r in rows]
    assert got == sorted([(i, *(sum(x[2] == k for x in b) for k in range(3)), hashlib.sha256(secrets.shown(b).encode()).hexdigest()) for i, b in base], key=str)
    out = secrets.redacted(docs)
    assert out.schema == docs.schema and out.count() == len(rows) and not any(plain_base(r["text"] or "") for r in out.collect())
    assert sorted(r["text"] or "" for r in out.collect() if "SECRET" not in (r["text"] or "")) == sorted(r[1] or "" for r in rows if not plain_base(r[1] or ""))
    assert secrets.secret_spans(empty).count() == 0 and [r["spans"] for r in secrets.secret_spans(nulls).collect()] == ["", ""]


def test_character_models_are_distributions():
    m = langid.train({"a": {"aba": 5, "abc": 2, "c": 1}, "b": {"bbb": 3}}, 3)
    for i in range(2):
        probs = [m.log_probs([w])[0][0, i] for w in ("aba", "bbb")]
        assert probs[i] > probs[1 - i]
    level = m.levels[0]
    p = np.maximum(level.count[:-1, 0] - level.discount[0], 0) + level.discount[0] * level.kinds[:-1, 0] / (m.alphabet + 1)
    total = p.sum() / level.total[:-1, 0].sum() + level.discount[0] * level.kinds[0, 0] / level.total[0, 0] * (m.alphabet + 1 - len(level.gram)) / (m.alphabet + 1)
    assert total == pytest.approx(1.0, abs=1e-3)


def test_language_id(docs, rows, empty, nulls):
    got = langid.languages(docs).collect()
    assert len(got) == len(rows)
    sure = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]
    truth = {r[0]: r[2] for r in rows}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in sure) >= 0.9 * len(sure)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    assert langid.languages(empty).count() == 0 and {r["lang_pred"] for r in langid.languages(nulls).collect()} == {"und"}
    assert langid.accepted(docs).schema == docs.schema and langid.accepted(empty).count() == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.languages(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.98


def test_poisson_inversion(spark):
    u = spark.createDataFrame([(x / 200,) for x in range(200)], "u double")
    for mean in (0.3, 2.5, 40.0):
        got = [r[0] for r in u.select(mixing.inverted(F.col("u"), F.lit(mean))).collect()]
        want = []
        for x in range(200):
            k, p = 0, math.exp(-mean)
            c = p
            while x / 200 >= c:
                k += 1
                p *= mean / k
                c += p
            want.append(k)
        assert got == want


def test_mixing(spark, docs, rows, empty, nulls):
    out = mixing.mixed_sources(docs, {"s0": 3.0, "s1": 1.0}, factor=4.0)
    assert set(docs.columns) < set(out.columns) and "copy_" in out.columns
    size = Counter()
    for r in out.collect():
        size[r["source"]] += len(r["text"] or "")
    assert set(size) <= {"s0", "s1"} and 2 < size["s0"] / size["s1"] < 4.5
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert sorted(map(str, mixing.mixed_rows(docs).collect())) == sorted(map(str, mixing.mixed_rows(docs.repartition(3)).collect()))
    assert mixing.mixed_rows(empty).count() == 0 and mixing.mixed_rows(nulls).count() >= 0
    many = spark.range(2000).select(F.col("id").alias("doc_id"))
    n = many.select(mixing.copies(F.col("doc_id"), F.lit(450.0)).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert n[0] == pytest.approx(450, rel=0.01) and n[1] == pytest.approx(450, rel=0.15)
