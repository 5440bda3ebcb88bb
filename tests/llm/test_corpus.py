"""Operators over all documents together: repeated passages, fingerprints, Katz scores, SimHash, images, the pipeline."""

import hashlib
import math
import pickle
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gateloom.llm import images, katz, queries, simhash, sketch, substring
from tests.oracle import check


def words(t, lower=False):
    b = (t or "").encode()
    return (b.lower() if lower else b).split()


def test_automaton_against_search():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 3, rng.integers(1, 15)).tolist() for _ in range(12)]
    a = substring.Automaton()
    for k, t in enumerate(texts):
        have = {tuple(x[i:j]) for x in texts[:k] for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max([n for n in range(1, e + 1) if tuple(t[e - n : e]) in have], default=0) for e in range(1, len(t) + 1)]
        assert a.matching(t) == want
        a.start()
        for w in t:
            a.add(w)


def test_substring(docs, rows, empty, nulls):
    for span, k in ((13, 5), (4, 2)):
        least = defaultdict(list)
        for r in rows:
            w = words(r[1])
            for i in range(len(w) - span + 1):
                least[tuple(w[i : i + span])].append(-1 if r[0] is None else r[0])
        want = []
        for r in rows:
            w = words(r[1])
            gone = [False] * len(w)
            for i in range(len(w) - span + 1):
                if min(least[tuple(w[i : i + span])]) < (-1 if r[0] is None else r[0]):
                    gone[i : i + span] = [True] * span
            left = [x for x, g in zip(w, gone) if not g]
            want.append((r[0], len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
        got = sorted(map(tuple, substring.without_repeats(docs, span, k).collect()), key=str)
        assert got == sorted(want, key=str) and any(r[2] for r in want)
    assert substring.without_repeats(empty).count() == 0 and [r["n_words"] for r in substring.without_repeats(nulls).collect()] == [0, 0]
    assert "kept" in substring.without_repeats(docs, text_too=True).columns


def shingles(t, k=5):
    w = words(t)
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({b" ".join(w)} if w else set())


def test_fingerprints(docs, rows, empty, nulls):
    got = sketch.edited_fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    nxt = {}
    for a, b in zip(order, order[1:] + order[:1]):
        nxt.setdefault((a[0], a[1] or ""), []).append(b[1] or "")
    by_text = {}
    for r in got:
        text = next(t for (i, t) in nxt if i == r["doc_id"])
        options = nxt[r["doc_id"], text]
        half = len(text) // 2
        edits = {hashlib.sha256((text[: len(text) - half] + o[:half]).encode()).hexdigest(): (text[: len(text) - half] + o[:half], o) for o in options}
        assert r["n_chars"] == len(text) and r["edited_sha256"] in edits
        edited, follows = edits[r["edited_sha256"]]
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for other, near in ((edited, r["near_edited"]), (follows, r["near_next"])):
            a, b = shingles(text), shingles(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    assert len(got) == len(rows) and sketch.edited_fingerprints(empty).count() == 0
    assert [(r["fingerprint"], r["near_next"]) for r in sketch.edited_fingerprints(nulls).collect()] == [("", 1.0)] * 2


def test_sketches(spark):
    df = spark.createDataFrame([("a", " ".join(map(str, range(3000)))), ("a", " ".join(map(str, range(2000, 5000)))), ("b", "x y")], "g string, text string")
    s = {r["g"]: r["sketch"] for r in sketch.sketches_by(df, ["g"]).collect()}
    whole = df.where("g = 'a'").select(sketch.sketch(F.col("text")).alias("s")).collect()
    assert s["a"] == sorted(set(whole[0]["s"]) | set(whole[1]["s"]))[: sketch.K] and len(s["b"]) == 1
    pair = spark.createDataFrame([(whole[0]["s"], whole[1]["s"])], "a array<bigint>, b array<bigint>")
    r = pair.select(sketch.resemblance(F.col("a"), F.col("b")), sketch.containment(F.col("a"), F.col("b")), sketch.distinct_count(F.col("a"))).first()
    assert r[0] == pytest.approx(1 / 5, abs=0.1) and r[1] == pytest.approx(1 / 3, abs=0.15) and r[2] == pytest.approx(2996, rel=0.3)


def test_katz(docs, rows, empty, nulls):
    toks, held = [], []
    count, pair = Counter(), Counter()
    for r in rows:
        w = [*words(r[1], True), b"\n"]
        h = r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 == 2
        toks.append(w)
        held.append(h)
        if not h:
            count.update(w)
            pair.update(zip([b"\r", *w], w))
    n, v = sum(count.values()), len(count)
    d = katz.discounts(np.array([sum(c == r for c in pair.values()) for r in range(1, 7)]))
    follow = defaultdict(dict)
    for (a, b), c in pair.items():
        follow[a][b] = c
    single = lambda w: (count[w] + 1) / (n + v + 1)

    def weight(a):
        s = follow[a]
        over = sum(s.values()) + all(c > 5 for c in s.values())
        return over, (1 - sum((d[c - 1] if c <= 5 else 1) * c for c in s.values()) / over) / (1 - sum(map(single, s)))

    def prob(a, w):
        if a not in follow:
            return single(w)
        over, alpha = weight(a)
        c = follow[a].get(w, 0)
        return (d[c - 1] if c <= 5 else 1) * c / over if c else alpha * single(w)

    for a in list(follow)[:20]:
        assert sum(prob(a, w) for w in count) + weight(a)[1] / (n + v + 1) == pytest.approx(1.0)
    want = sorted(((r[0], h, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10(single(x)) for x in w), 6), round(sum(math.log10(prob(a, x)) for a, x in zip([b"\r", *w], w)), 6)) for r, w, h in zip(rows, toks, held)), key=str)
    got = sorted(((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in katz.katz_scores(docs).collect()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], atol=1e-5)
    assert katz.katz_scores(empty).count() == 0 and [r["n_tokens"] for r in katz.katz_scores(nulls).collect()] == [1, 1]


def test_katz_parts_of_hot_contexts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(katz, "SALT_TOKENS", 3)
    b = katz.Block(pa.table({"text": ["a b a c a d a e a b"], "held_out": [False]}))
    b.pairs(b.count)
    assert len(b.name) > b.contexts and b.part_size.sum() == len(b.word) and (np.diff(b.name.astype(float)) > 0).all()


def test_fingerprint_bits():
    w = words("A b c d B", True)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) > 1.5)
    assert simhash.fingerprint(w) == want and simhash.fingerprint([]) == 0 and simhash.fingerprint([b"a"]) == xxhash.xxh64_intdigest(b"a", 42)


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 8])
def test_bit_slices_against_popcounts(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 6))) for _ in range(60)]))
    planes = simhash.planes_of(fps)
    blk, q = np.repeat(np.arange(len(planes)), len(fps)), np.tile(fps, len(planes))
    hit = simhash.within(planes, blk, q, radius)
    lanes = (np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(planes), len(fps), 64).transpose(1, 0, 2).reshape(len(fps), -1))[:, : len(fps)]
    assert (lanes.astype(bool) == (np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)).all()


def roots(fps, radius):
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= radius)
    return simhash.roots(len(fps), a, b)


def test_components(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.uint64(sum({1 << int(b) for b in rng.integers(0, 64, k)})) for k in (1, 2, 3, 4, 5) for _ in range(3)]))
    ids = rng.permutation(len(fps))
    df = spark.createDataFrame([(int(i), int(f.view(np.int64))) for i, f in zip(ids, fps)], "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(df).collect()}
    at = roots(fps, 3)
    assert got == {int(i): int(min(ids[at == r])) for i, r in zip(ids, at)}


def test_simhash(docs, rows, empty, nulls):
    got = simhash.simhash_components(docs).collect()
    fps = np.array([simhash.fingerprint(words(r[1], True)) for r in rows], np.uint64)
    at = roots(fps, 3)
    for r, f, k in zip(rows, fps, at):
        known = [x[0] for x, y in zip(rows, at) if y == k and x[0] is not None]
        match = [g for g in got if g["doc_id"] == r[0] and g["fingerprint"] == f"{int(f):016x}"]
        assert match and all(g["component_id"] == (min(known) if known else None) for g in match)
    assert len(got) == len(rows)
    assert simhash.simhash_components(empty).count() == 0 and [tuple(r) for r in simhash.simhash_components(nulls).collect()] == [(None, "0" * 16, None)] * 2


def test_near_duplicate_choice(docs, rows, empty, nulls):
    out = simhash.first_of_each(docs)
    kept = out.collect()
    assert out.columns == docs.columns
    texts = [r["text"] or "" for r in kept if len((r["text"] or "").split()) > 0]
    assert len(texts) == len(set(texts)) and set(texts) <= {r[1] for r in rows}
    sets = [shingles(t.lower()) for t in texts]
    assert max((len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if len(a) > 40), default=0) < 0.8
    assert simhash.first_of_each(empty).count() == 0 and simhash.first_of_each(nulls).count() == 1


def test_near_duplicates_just_above_the_threshold(spark):
    """Texts whose sets of five-word shingles are 0.8 to 0.85 alike leave one; those just below stay."""
    rng = np.random.default_rng(6)
    text = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    rows, groups = [], 80
    for g in range(groups):
        w = text(int(rng.integers(60, 300)))
        k = len(w)
        grown = w + text(round(0.2 * k)) if g % 2 else w[: round(0.82 * k)]
        rows += [(4 * g, " ".join(w)), (4 * g + 1, " ".join(grown)), (4 * g + 2, " ".join(w[: round(0.7 * k)] + text(3)))]
    sets = [shingles(t) for _, t in rows]
    alike = lambda a, b: len(a & b) / len(a | b)
    gone = {rows[3 * g + 1][0] for g in range(groups) if alike(sets[3 * g], sets[3 * g + 1]) >= 0.8}
    gone |= {rows[3 * g + 2][0] for g in range(groups) if max(alike(sets[3 * g], sets[3 * g + 2]), alike(sets[3 * g + 1], sets[3 * g + 2]) if rows[3 * g + 1][0] in gone else 0) >= 0.8}
    kept = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(gone) > groups // 2 and kept == {i for i, _ in rows} - gone


def test_images(spark):
    rng = np.random.default_rng(1)
    pic = lambda: np.kron(rng.integers(0, 255, (30, 16)), np.ones((5, 5))).astype(np.uint8)
    pgm = lambda a: b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.tobytes()
    a, b = pic(), pic()
    edited = a.copy()
    edited[60:75] = 0
    rows = [(1, pgm(a)), (2, pgm(b)), (3, pgm(a[30:140, 5:])), (4, pgm(edited)), (5, pgm(a)), (6, None), (7, b""), (8, b"P5 bad"), (None, pgm(a)), (9, pgm(pic()))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, image binary, bin string")
    got = {r["id"]: r["class_id"] for r in images.image_copies(df).collect()}
    assert [got[i] for i in (1, 3, 4, 5)] == [1] * 4
    assert all(got[i] == i for i in (2, 6, 7, 8, 9)) and got[None] is None
    assert images.image_copies(df.limit(0)).count() == 0
    assert images.decoded(images.raster("ab>c\nd" + "x" * 100)).shape == (4, 64)


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    """Short texts too, a large group of near copies, and keys dealt in parts: what stays is what brute force leaves."""
    rng = np.random.default_rng(12)
    line = [f"l{i}" for i in range(9)]
    rows = []
    for g in range(60):
        w = line + [f"w{i}" for i in rng.integers(0, 3_000, int(rng.integers(4, 90)))]
        for _ in range(45 if g == 0 else int(rng.integers(1, 5))):
            v = list(w)
            for _ in range(int(rng.integers(0, 3))):
                v[int(rng.integers(0, len(v)))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(v)))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = set(simhash.roots(len(rows), *np.array(links).T).tolist())
    for split in (4096, 10):
        monkeypatch.setattr(simhash, "SPLIT", split)
        got = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == want and 60 <= len(want) < len(rows)


def test_near_duplicates_of_a_group_below_the_threshold(spark, monkeypatch):
    """Texts of one form that are all a bit too unlike: no table between the stages grows with the square of their number."""
    whole, sizes = simhash.stored, []

    def stored(df, name="stage"):
        out = whole(df, name)
        sizes[-1].append((name, out.count()))
        return out

    monkeypatch.setattr(simhash, "stored", stored)
    for n in (50, 200):
        rng, rows = np.random.default_rng(3), []
        for i in range(n):
            w = [f"f{k}" for k in range(120)]
            for k in rng.choice(120, 3, replace=False):
                w[k] = f"e{rng.integers(0, 10**6)}"
            rows.append((i, " ".join(w)))
        sets = [shingles(t) for _, t in rows]
        links = [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        sizes.append([])
        got = {r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == set(simhash.roots(n, *np.array(links, int).reshape(-1, 2).T).tolist()) and len(got) > n / 2
    assert all(many <= 6 * max(few, 50) for (_, few), (name, many) in zip(*sizes) if name != "links"), sizes


def test_odd_sketches_rule_out_nothing_similar():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 32, int(rng.integers(50, 6_000)), np.uint32))
        k = int(len(a) * rng.uniform(0, 0.5))
        sets += [a, np.unique(np.concatenate([a[k // 2 :], rng.integers(0, 1 << 32, k - k // 2, np.uint32)]))]
    n = np.array([len(x) for x in sets])
    near = simhash.Sketches([simhash.odd_sketch(x) for x in sets], n).near
    x, y = np.arange(0, 600, 2), np.arange(1, 600, 2)
    alike = np.array([simhash.jaccard(sets[i], sets[j]) for i, j in zip(x, y)])
    kept = near(x, y)
    assert kept[alike >= 0.8].all() and not kept[alike < 0.68].any() and (alike < 0.68).any() and (alike >= 0.8).any()
    fit = simhash.sizes_fit(n[x[1:]], n[x[:-1]])
    assert fit.any() and not near(x[1:][fit], x[:-1][fit]).any()


def test_pairs_of_a_large_key_come_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 1_000)
    found = list(simhash.pairs_in(np.zeros(300, np.int64), np.zeros(300, np.uint64), 3))
    assert sum(len(x) for x, _ in found) == 300 * 299 // 2 and max(len(x) for x, _ in found) <= 1_000


def corner_rows(rng, n):
    return np.rec.fromarrays([rng.integers(0, 1 << 64, n, np.uint64), rng.permutation(400)[:n] * 5, rng.integers(0, 60, n), np.zeros(n), np.zeros(n)], dtype=images.CORNER)


def linked(spark, pictures, **how):
    df = spark.createDataFrame([(i, len(r), bytearray(r.tobytes())) for i, r in pictures.items()], "id bigint, n int, data binary")
    return sorted((r["b"], r["a"]) for r in images.links(df, **how).collect())


def test_partitions_of_slots(spark):
    for n in (1, 7, 12, 211):
        names = images.slots(n).tolist()
        got = spark.createDataFrame([(x,) for x in names], "x int").repartition(n, "x").select("x", F.spark_partition_id()).collect()
        assert sorted(p for _, p in got) == list(range(n)) and {x: p for x, p in got} == {x: p for p, x in enumerate(names)}


def test_image_copies_behind_unrelated_leads(spark):
    """Each corner of two copies stands first in an unrelated image too, each time another one; equal small images link as well."""
    rng = np.random.default_rng(4)
    copy = corner_rows(rng, 30)
    edited = copy.copy()
    edited["y"] += 12
    edited["d"][:15] ^= np.uint64(1)
    pictures = {100: copy, 101: edited}
    for i in range(10):
        pictures[i] = corner_rows(rng, 30)
        pictures[i]["d"][:3] = copy["d"][3 * i : 3 * i + 3]
    assert linked(spark, pictures) == [(101, 100)]
    small = images.raster("few corners" * 5)
    rows = spark.createDataFrame([(3, small), (1, small), (2, images.raster("others" * 5))], "id bigint, image binary")
    assert {r["id"]: r["class_id"] for r in images.image_copies(rows).collect()} == {1: 1, 2: 2, 3: 1}


def test_corners_move_once_a_block(spark):
    pictures = spark.createDataFrame([(i, bytearray(b"x")) for i in range(20)], "id bigint, data binary")
    pairs = spark.createDataFrame([(b % 2, b, a) for b in range(20) for a in range(b)], "block int, b bigint, a bigint")
    rows = images.moved(pairs, pictures).collect()
    assert sum(r["data"] is not None for r in rows) <= 40 and sum(r["other"] is not None for r in rows) == 190


def test_few_corners_move_at_a_time(spark, monkeypatch):
    """All pairs of 200 pictures, dealt over 64 tasks: a step moves a picture a few times at most, and what is linked is what comparing each pair tells."""
    rng, pictures = np.random.default_rng(6), {}
    for i in range(200):
        pictures[i * 3] = corner_rows(rng, 24)
        if i % 4 == 1:
            pictures[i * 3]["d"][: 12 + i % 11] = pictures[i * 3 - 3]["d"][: 12 + i % 11]
            for c in ("y", "x"):
                pictures[i * 3][c] = pictures[i * 3 - 3][c] + 12
    frame = spark.createDataFrame([(i, len(r), bytearray(r.tobytes())) for i, r in pictures.items()], "id bigint, n int, data binary").persist()
    pairs = spark.createDataFrame([(b, a) for b in pictures for a in pictures if a < b], "b bigint, a bigint")
    weigh, whole, sizes = images.weights(frame), images.moved, []

    def moved(*args):
        rows = whole(*args)
        sizes.append(rows.where("data IS NOT NULL").count())
        return rows

    monkeypatch.setattr(images, "moved", moved)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = sorted((r["b"], r["a"]) for r in images.verified(pairs, frame, weigh).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    scores = {(b, a): images.score(pictures[a], pictures[b], weigh.of(pictures[b]["d"])) for b in pictures for a in pictures if a < b}
    assert got == sorted(p for p, (n, share) in scores.items() if n >= images.agreeing(24) and share >= images.SHARE) and 10 < len(got) < 50
    assert max(sizes) <= 8 * len(pictures), sizes


def test_weights_are_sent_without_empty_bits():
    weigh = images.Weights(np.array([3, 9]), np.array([5, 7]), 2, 5_000)
    weigh.several[:] = 0
    weigh.several[[5, 70_000]] = 7
    sent = pickle.dumps(weigh)
    got, key = pickle.loads(sent), np.arange(10_000)
    assert len(sent) < 100_000 and (got.several == weigh.several).all() and (got.held(key) == weigh.held(key)).all() and (got.useful(key) == weigh.useful(key)).all()


def test_edges_of_many_images_at_once():
    rng = np.random.default_rng(2)
    many = [corner_rows(rng, n) for n in (1, 30, 5)]
    for r in many:
        r["x"], r["scale"] = rng.integers(0, 200, len(r)), rng.integers(0, 2, len(r))
    every = images.at_edge(np.concatenate(many), np.repeat(np.arange(3), [len(r) for r in many]))
    assert every.tolist() == np.concatenate([images.at_edge(r) for r in many]).tolist() and every.any() and not every.all()


def test_pictures_that_met_in_one_corner_are_compared(spark):
    """Of what agrees only one corner asks and has an equal half, too little of the weight to tell: the pair is compared all the same."""
    rng = np.random.default_rng(3)
    b = corner_rows(rng, 40)
    b["y"] = np.r_[np.arange(22), 300 + 5 * np.arange(18)]
    a = np.concatenate([b, corner_rows(rng, 1)])
    a["d"][22:28] ^= np.uint64(1 << 40 | 1)
    a["d"][28:] = rng.integers(0, 1 << 64, 13, np.uint64)
    asks = images.weights(spark.createDataFrame([(i, len(r), bytearray(r.tobytes())) for i, r in ((1, a), (2, b))], "id bigint, n int, data binary")).asking(b["d"], np.array([40]))
    assert 0 < asks[:22].sum() < 0.05
    assert linked(spark, {1: a, 2: b}) == [(2, 1)]


def test_links_of_alike_images_are_a_forest(spark):
    """Links of a large group don't grow with its square; nor do the pairs compared, as those that links connect are left out."""
    rng, pictures = np.random.default_rng(5), {}
    whole = corner_rows(rng, 40)
    for i in range(150):
        pictures[i] = whole.copy()
        pictures[i]["d"][rng.choice(40, 4, replace=False)] = rng.integers(0, 1 << 64, 4, np.uint64)
    found = linked(spark, pictures)
    assert (simhash.roots(150, *np.array(found).T) == 0).all() and len(found) < 4 * 150
    frame = spark.createDataFrame([(i, len(r), bytearray(r.tobytes())) for i, r in pictures.items()], "id bigint, n int, data binary")
    weigh, packs, compared = images.weights(frame), [], []
    for i, r in pictures.items():
        asks = weigh.asking(r["d"], np.array([40])) > 0
        packs.append(images.packed(np.array([i]), np.array([40]), np.array([asks.sum()]), np.concatenate([r[asks], r[~asks]]), np.full(40, sum(images.USEFUL), np.uint8)))

    class Meeting(images.Meeting):
        def compare(self, b, a):
            compared.append(len(b))
            super().compare(b, a)

    for held in (images.HELD, 1_000):
        with pytest.MonkeyPatch.context() as to:
            to.setattr(images, "Meeting", Meeting)
            to.setattr(images, "HELD", held)
            ids, forest = images.copies_in(packs, [], [], weigh)
            assert (forest.roots() == 0).all() and len(forest.links) == 149
            half = images.copies_in(packs[:75], packs[75:], [images.squeeze(np.stack([np.arange(75), np.zeros(75, np.int64)]))], weigh)[1]
            assert (half.roots() == 0).all() and len(half.links) == 75
    assert sum(compared) < 4 * 150 * 8


def test_surroundings_against_counting():
    """Lanes of 8 and of 16 bits."""
    rng = np.random.default_rng(7)
    for n, rows in ((300, 400), (900, 60)):
        r = corner_rows(rng, 300)
        r = np.concatenate([r] * 3)[:n]
        r["y"], r["scale"], r["d"] = rng.integers(0, rows, n), rng.integers(0, 2, n), rng.integers(0, 1 << 64, n, np.uint64)
        of = np.repeat([0, 1], [n // 3, n - n // 3])
        bits = [np.unpackbits(images.mixed(k.view(np.uint64)).view(np.uint8).reshape(n, 8), axis=1, bitorder="little") for k in images.keys(r["d"])]
        votes = (bits[0].astype(int) + bits[1]) * 2 - 2
        near = (of[:, None] == of) & (r["scale"][:, None] == r["scale"]) & (r["y"] >= r["y"][:, None] - images.AROUND) & (r["y"] <= r["y"][:, None] + images.AROUND)
        want = np.packbits(near.astype(int) @ votes > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)
        assert (images.surroundings(of, r) == want).all()


def test_images_against_all_pairs(spark, monkeypatch):
    """Copies, crops and edits among images that share furniture: the classes are those of comparing all pairs, dense keys and split keys too."""
    rng = np.random.default_rng(9)
    furniture, pictures, own = corner_rows(rng, 12), {}, {}
    for g in range(30):
        whole = np.concatenate([furniture, corner_rows(rng, 40)])
        for c in range(1 + g % 3 if g else 25):
            r = whole.copy()
            r["d"][rng.choice(52, 6, replace=False)] = rng.integers(0, 1 << 64, 6, np.uint64)
            pictures[len(pictures) * 7 % 1000] = r[np.argsort(r["y"])] if c % 2 else r[r["y"] < 1500]
    ids = list(pictures)
    frame = spark.createDataFrame([(i, len(r), bytearray(r.tobytes())) for i, r in pictures.items()], "id bigint, n int, data binary")
    weigh = images.weights(frame)
    a, b = [], []
    for i, x in enumerate(ids):
        for j, y in enumerate(ids):
            p, q = pictures[x], pictures[y]
            if (len(q), -y) < (len(p), -x):
                n, share = images.score(p, q, weigh.of(q["d"]))
                if n >= images.agreeing(len(q)) and share >= images.SHARE:
                    a.append(i), b.append(j)
    want = simhash.roots(len(ids), np.array(a), np.array(b))
    assert len(set(want)) < len(ids) - 20
    for split, dense in ((4096, 16), (4096, 1), (5, 2)):
        monkeypatch.setattr(images, "SPLIT", split)
        monkeypatch.setattr(images, "FAR", 64)  # without the filter by surroundings the search is exact
        found = linked(spark, pictures, dense=dense)
        at = {i: k for k, i in enumerate(ids)}
        got = simhash.roots(len(ids), np.array([at[x] for x, _ in found]), np.array([at[y] for _, y in found]))
        assert (got == want).all(), (split, dense)


def test_small_images_and_crops_link(spark):
    """A crop of five corners links to its whole; most crops to half of a page's rows do, 30 to 100 rows."""
    rng = np.random.default_rng(8)
    whole = corner_rows(rng, 30)
    assert linked(spark, {1: whole, 2: whole[9:14], 3: whole[:2]}) == [(2, 1)]
    pages = [images.decoded(images.raster(r["html"])) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").collect()]
    n = len(pages)
    pages += [p[len(p) // 4 : len(p) // 4 + len(p) // 2] for p in pages]
    image, *cols = images.described(pages)
    y, x, scale, turn, d = cols
    rows = np.rec.fromarrays([d, y, x, scale, turn], dtype=images.CORNER)
    own = {i: rows[image == i] for i in range(len(pages))}
    found = {tuple(sorted(p)) for p in linked(spark, own)}
    assert sum((i, i + n) in found for i in range(n)) >= 0.6 * n, len(found)
    assert sum(a % n != b % n for a, b in found) <= 0.005 * n * (2 * n - 1)


def test_queries_and_sql(spark, small):
    for name, q in queries.QUERIES.items():
        source = "pages" if name.startswith("op1_") else "documents"
        n = spark.read.parquet(f"{small}/{source}.parquet").count()
        if name.startswith(("op2_", "op8_")):
            assert q(spark, small).count() > 0
        else:
            assert q(spark, small).count() == n
    for name, sql in queries.ORACLE_SQL.items():
        check(spark, small, queries.QUERIES[name], sql)


def test_pipeline(spark, small, docs, empty, nulls):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    for source in (docs, empty, nulls):
        d = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, small)
            assert out.columns == d.columns
            d = spark.createDataFrame(out.collect(), out.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, d, small).count() >= d.count()
    out = corpus_pipeline.run(spark, small)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
