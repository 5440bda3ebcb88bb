"""SimHash near-duplicates: bit planes, carry-save counters, and components of the links.

Fingerprints are equal in most documents that are copies, so the search runs over distinct ones. Of two that differ in
at most `radius` bits, BANDS bands of bits leave at least BANDS - radius untouched; for each choice of so many bands a
table is keyed by their bits, and within a key all are compared, exactly and without a cap. The comparison is bit-sliced:
64 fingerprints stand in a block as one word for each bit (the planes); a block's distances to a query grow together
in carry-save counters, plane by plane, and a block is abandoned once all its lanes have exceeded the radius.

A key's matches leave its task only as a spanning forest, one link for each fingerprint at most. Links become
components by alternating large-star and small-star steps, with joins that AQE can split at hot ends; each step is
written to the shared folder, and only two sums reach the driver.

Cases: a null or empty text has no shingle and fingerprint zero, linked like any other; a null doc_id is kept, and its
component is the least doc_id that isn't null (null if there is none); repeated rows each get their row; an empty
table gives an empty table; other columns are ignored, or kept by first_of_each().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateloom.llm.common import ascii_words, bites, dealt, forget, gathered, lean, mixed, shards, slots, stored, texts_of

#: Words of a shingle; bits that linked fingerprints differ in, at most; bands.
WORDS, RADIUS, BANDS = 3, 3, 6
#: Rows (query x block) that are compared at a time.
ROWS = 400_000
#: Fingerprints of a key from which on they are compared in blocks; pairs that are given at a time, about.
FEW, PAIRS = 8, 1_000_000
_ONE = np.uint64(1)


def fingerprint(words: list[bytes], k: int = WORDS, seed: int = 42) -> int:
    """The majority of each bit over the XXH64 of all shingles, repeats included."""
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64, max(1, len(words) - k + 1))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        ones += np.unpackbits(h[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """doc_id and fp (64 bits as bigint) for each row of docs(doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in bites(batches):
            fp = np.array([fingerprint(ascii_words(t, lower=True), k) for t in texts_of(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, fp bigint")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 words for each block of 64 fingerprints (the last one padded by its first): word b has bit b of each."""
    n = -(-len(fps) // 64)
    lanes = np.concatenate([fps, np.full(64 * n - len(fps), fps[64 * (n - 1)], np.uint64)]).reshape(n, 64)
    bits = np.unpackbits(lanes.view(np.uint8).reshape(n, 64, 8), axis=2, bitorder="little")  # block, lane, bit
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64).reshape(n, 64)


def within(planes: np.ndarray, block: np.ndarray, query: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row (block, query): a word with the lanes whose fingerprints differ from the query in radius bits at most.

    The carry-save counters start so high that a lane overflows at its first difference beyond the radius.
    """
    alive = np.arange(len(query))
    out = np.zeros(len(query), np.uint64)
    m = radius.bit_length()
    start = (1 << m) - 1 - radius
    counters = [np.full(len(query), ~np.uint64(0) if start >> j & 1 else np.uint64(0)) for j in range(m)]
    over = np.zeros(len(query), np.uint64)
    blk, q = block, query
    for bit in range(64):
        carry = planes[blk, bit] ^ (np.uint64(0) - (q >> np.uint64(bit) & _ONE))
        for j in range(m):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if bit % 4 == 3 and bit > 8:
            left = over != ~np.uint64(0)
            if left.sum() < 0.8 * len(left):  # abandon blocks whose lanes have all exceeded the radius
                alive, blk, q, over, counters = alive[left], blk[left], q[left], over[left], [x[left] for x in counters]
            if not len(alive):
                return out
    out[alive] = ~over
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component under the links a-b."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[a], at[b])
        new = at.copy()
        np.minimum.at(new, at[a], low)
        np.minimum.at(new, at[b], low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def pairs_in(key: np.ndarray, fps: np.ndarray, radius: int = RADIUS):
    """x, y: places x < y of all fingerprints of equal key (sorted) that differ in radius bits at most; each y gets its x in order.

    Keys of FEW fingerprints or less don't fill the lanes of a block: theirs are counted one pair at a time.
    """
    n = len(fps)
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    many = size > FEW
    small = np.repeat(~many, size)
    for d in range(min(FEW, n) - 1, 0, -1):
        x = np.nonzero(small[:-d] & (key[d:] == key[:-d]))[0]
        x = x[np.bitwise_count(fps[x] ^ fps[x + d]) <= radius]
        if len(x):
            yield x, x + d
    # lanes of a block beyond a key's own fingerprints are masked off
    blocks, base, count, queries = [], [], [], []

    def flush():
        if not blocks:
            return
        planes = np.concatenate(blocks)
        m = np.array(count)
        start = np.array(base)
        per = np.concatenate(queries)  # (block, query place)
        for i in range(0, len(per), ROWS):
            blk, q = per[i : i + ROWS, 0], per[i : i + ROWS, 1]
            hit = within(planes, blk, fps[q], radius)
            hit &= np.where(m[blk] == 64, ~np.uint64(0), (_ONE << m[blk].astype(np.uint64) % np.uint64(64)) - _ONE)
            some = np.nonzero(hit)[0]
            ends, a = np.cumsum(np.bitwise_count(hit[some]), dtype=np.int64), 0
            while a < len(some):  # where all are alike a row has 64 pairs
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
                part, a = some[a:b], b
                bits = np.unpackbits(hit[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, lane = np.nonzero(bits)
                x, y = q[part[r]], start[blk[part[r]]] + lane
                new = x < y
                yield x[new], y[new]
        blocks.clear(), base.clear(), count.clear(), queries.clear()

    held = nblocks = 0
    for f, s in zip(first[many].tolist(), size[many].tolist()):
        own = planes_of(fps[f : f + s])
        q = np.arange(f, f + s)
        for i in range(len(own)):  # each pair once: a block meets the queries before its end
            part = q[: min(s, 64 * (i + 1))]
            blocks.append(own[i : i + 1])
            base.append(f + 64 * i)
            count.append(min(64, s - 64 * i))
            queries.append(np.stack([np.full(len(part), nblocks), part], axis=1))
            nblocks += 1
            held += len(part)
            if held >= 4 * ROWS or nblocks >= 20_000:
                yield from flush()
                held = nblocks = 0
    yield from flush()


def joined(n: int, pairs) -> np.ndarray:
    """The least place of each of n places' component under pairs (x, y), which come piece by piece."""
    at, a, b = np.arange(n), [], []

    def forest() -> np.ndarray:
        out = roots(n, np.concatenate([*a, np.arange(n)]), np.concatenate([*b, at])) if a else at
        a.clear(), b.clear()
        return out

    for x, y in pairs:
        a.append(x)
        b.append(y)
        if sum(map(len, a)) > 2_000_000:
            at = forest()
    return forest()


def links_in(key: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of the links between fingerprints of equal key; key sorted."""
    at = joined(len(fps), pairs_in(key, fps, radius))
    child = np.nonzero(at != np.arange(len(fps)))[0]
    return child, at[child]


def keys_of(fps: np.ndarray, bands: int = BANDS, radius: int = RADIUS) -> list[tuple[int, np.ndarray]]:
    """For each choice of bands - radius bands: its number and the key of each fingerprint in its table."""
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [(t, fps & np.uint64(sum(m))) for t, m in enumerate(combinations(masks, bands - radius))]


def links(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """Links (u, v) between nodes whose fp differ in radius bits at most, enough of them to connect all that are linked. distinct has node and fp (bigint)."""
    n = shards(distinct.sparkSession)

    def spread(batches):
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, key in keys_of(fps, bands, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), t, np.int32)), pa.array(key.view(np.int64)), *b.columns], names=["t", "key", "node", "fp"])

    def compare(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        t, key, node, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        for i in np.unique(t):
            own = np.nonzero(t == i)[0]
            own = own[np.argsort(key[own], kind="stable")]
            u, v = links_in(key[own], fp[own].view(np.uint64), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(node[own[u]]), pa.array(node[own[v]])], names=["u", "v"])

    return distinct.select("node", "fp").mapInArrow(spread, "t int, key bigint, node bigint, fp bigint").repartition(n, "t", "key").mapInArrow(compare, "u bigint, v bigint").distinct()


def components(found: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of links (u, v): root is the least node of its component. root itself has no row."""
    edges = stored(found.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    for _ in range(most):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == state or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(now)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "links")
    raise RuntimeError(f"no fixed point after {most} rounds")


def simhash_components(docs: DataFrame, k: int = WORDS, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs(doc_id, text)."""
    fps = stored(fingerprints(docs, k), "fingerprints")
    return grouped(fps, radius, bands).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(fps: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """fps(doc_id, fp) with component_id."""
    least = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("_least")), "distinct")
    root = components(links(least.withColumn("node", F.col("fp")), radius, bands))
    member = least.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "_least")
    ids = member.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = member.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp")


#: For first_of_each(): words of a shingle; similarity of shingle sets from which on documents are linked; documents whose shingles are counted, about.
SHINGLE, SIMILAR, SAMPLE = 5, 0.8, 5_000
#: Bits that fingerprints of two such sets differ in, at most: on average it is a tenth of 64 at this similarity, and half for unrelated sets.
FAR = 22
#: The same for three more fingerprints together: 29 of 192 on average, with a deviation of 5, and 96 for unrelated sets.
FAR_MORE = 62
#: Bits of an odd sketch at most.
ODD = 8_192
#: Nodes of a key from which on it is dealt in parts, and nodes that all parts have.
SPLIT, LEADS = 4_096, 32


def shingle_set(text: str) -> np.ndarray:
    """XXH64 of the distinct shingles of SHINGLE words, sorted; of all words together if they are fewer; none without a word."""
    words = ascii_words(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    grams = {b" ".join(g) for g in zip(*(words[i:] for i in range(SHINGLE)))} if len(words) >= SHINGLE else {b" ".join(words)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def node_of(members: np.ndarray) -> int:
    """The digest that stands for a set."""
    return xxhash.xxh3_64_intdigest(members.tobytes())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets, not both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def set_print(members: np.ndarray) -> int:
    """The majority of each bit over the members of a set."""
    ones = np.unpackbits(members.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(members), bitorder="little").view(np.uint64)[0])


def more_prints(members: np.ndarray) -> tuple[int, ...]:
    """Three more fingerprints of a set, as signed integers, by other hashes of its members."""
    return tuple(int(np.uint64(set_print(mixed(members + np.uint64(k)))).view(np.int64)) if len(members) else 0 for k in (1, 2, 3))


#: A set under one of its first members: part of the key and how many there are, the set's node, size and fingerprint.
ENTRY = {"key": np.uint32, "salt": np.int32, "split": np.int32, "node": np.uint64, "n": np.int32, "fp": np.uint64}
MET = "u bigint, v bigint, key bigint, node bigint, n int, fp bigint"


def sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be SIMILAR."""
    return np.minimum(n, m) >= (SIMILAR - 1e-9) * np.maximum(n, m)


def odd_sketch(members: np.ndarray) -> bytes:
    """A bit for each remainder of a set's members, set if an odd number of them has it: 4 bits a member or so, ODD bits at most.

    Sketches of two sets differ in no more bits than the sets in members, also when the longer one is folded to the shorter's length.
    """
    bits = min(ODD, max(64, 1 << (4 * len(members) - 1).bit_length())) if len(members) else 64
    return np.packbits(np.bincount((members % np.uint32(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


class Sketches:
    """Odd sketches of sets of n members, to rule out pairs that can't be SIMILAR."""

    def __init__(self, sketches: list[bytes], n: np.ndarray):
        self.n, self.words = n.astype(np.int64), np.array([len(x) // 8 for x in sketches], np.int64)
        own = {w: np.nonzero(self.words == w)[0] for w in np.unique(self.words).tolist()}
        rows = {w: np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64).reshape(-1, w) for w, at in own.items()}
        self.tables = {}
        for w, at in own.items():
            place, table = np.full(len(sketches), -1), [rows[w]]
            place[at] = np.arange(len(at))
            if 2 * w in own:
                place[own[2 * w]] = len(at) + np.arange(len(own[2 * w]))
                table.append(rows[2 * w][:, :w] ^ rows[2 * w][:, w:])
            self.tables[w] = place, np.concatenate(table)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """False for pairs of places whose sets differ in too many members."""
        out, words = np.ones(len(x), bool), np.minimum(self.words[x], self.words[y])
        most = (1 - SIMILAR) / (1 + SIMILAR) * (self.n[x] + self.n[y]) + 1e-6
        for w in np.unique(words).tolist():
            place, table = self.tables[w]
            own = np.nonzero((words == w) & (place[x] >= 0) & (place[y] >= 0))[0]
            for i in range(0, len(own), step := max(1, (1 << 20) // w)):
                p = own[i : i + step]
                out[p] = np.bitwise_count(table[place[x[p]]] ^ table[place[y[p]]]).sum(axis=1, dtype=np.int64) <= most[p]
        return out


def grouped_nodes(at: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """sig and columns of the places that share their component (at) with others, once for each (sig, node): sig is a digest of the nodes of the component."""
    digest = np.zeros(len(at), np.uint64)
    np.add.at(digest, at, mixed(columns["node"].view(np.uint64)))
    own = np.nonzero(np.bincount(at, minlength=len(at))[at] > 1)[0]
    sig = digest[at[own]].view(np.int64)
    once = np.unique(np.stack([sig, columns["node"][own]]), axis=1, return_index=True)[1]
    return pa.RecordBatch.from_arrays([pa.array(sig[once]), *(pa.array(c[own[once]]) for c in columns.values())], names=["sig", *columns])


def met(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"u": pa.int64(), "v": pa.int64(), "key": pa.int64(), "node": pa.int64(), "n": pa.int32(), "fp": pa.int64()}
    signed = lambda x: x.view(np.int64) if x.dtype == np.uint64 else x
    return pa.RecordBatch.from_arrays([pa.array(signed(columns[c]), t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def meet(batches):
    """MET rows of the entries of a task: each set with the first one by a hash that may be similar, under each key; and the entries of keys where more meet."""
    forget()
    lean()
    e = gathered(batches, ENTRY)
    order = np.lexsort((mixed(e["node"]), e["salt"], e["key"]))
    e = {c: x[order] for c, x in e.items()}
    new = (e["key"][1:] != e["key"][:-1]) | (e["salt"][1:] != e["salt"][:-1])
    # a collision of keys or a set of equal rows shows as one node twice
    group = np.cumsum(np.r_[False, new])[: len(order)]
    met_one, more = np.zeros(len(order), bool), np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    out, held = [], 0
    for x, y in pairs_in(group, e["fp"], FAR):
        fit = sizes_fit(e["n"][x], e["n"][y]) & (e["node"][x] != e["node"][y])
        x, y = x[fit], y[fit]
        by = np.lexsort((x, y))
        x, y = x[by], y[by]
        lead = ~met_one[y] & (np.r_[True, y[1:] != y[:-1]] if len(y) else fit[:0])
        more[group[y[~lead]]] = True
        met_one[y] = True
        out.append(np.unique(np.stack([e["node"][y[lead]], e["node"][x[lead]]]), axis=1))
        held += out[-1].shape[1]
        if held > 1_000_000:
            pairs = np.unique(np.concatenate(out, axis=1), axis=1)
            yield met(u=pairs[0], v=pairs[1])
            out, held = [], 0
    pairs = np.unique(np.concatenate([np.zeros((2, 0), np.uint64), *out], axis=1), axis=1)
    yield met(u=pairs[0], v=pairs[1])
    own = np.nonzero(more[group] | (e["split"] > 1))[0]
    for i in range(0, len(own), 100_000):
        yield met(**{c: e[c][own[i : i + 100_000]] for c in ("key", "node", "n", "fp")})


def set_links(texts: DataFrame, least: DataFrame, common: tuple[np.ndarray, np.ndarray], every: int = 1) -> DataFrame:
    """Links (u, v) of the nodes (digests of shingle sets) of a similarity of SIMILAR or more, enough to connect all that are linked.

    texts has id, own and text, least the node and its least (id, own). Of two similar sets each has one of the first
    n - ceil(SIMILAR n) + 1 members of the other among its own first ones, in any order of all members: rare ones go first
    here (common has members and how often one of `every` documents has them). Sets with a first member in common are compared
    by fingerprint, bit-sliced; each is set against the first of those within FAR bits, and then, where no link
    has connected them yet, all others are, by odd sketches, which rule out nothing that is similar, then by their members.
    What counts is the Jaccard similarity. Only the texts that are compared move.
    """
    spark = texts.sparkSession
    n_parts = shards(spark)
    names, told = slots(n_parts), spark.sparkContext.broadcast((*common, every))

    def spread(batches):
        member, often, every = told.value
        for b in bites(batches, 2048):
            key, node, size, fp, times = [], [], [], [], []
            for h in map(shingle_set, texts_of(b.column("text"))):
                n = len(h)
                if not n:
                    continue
                seen = np.zeros(n, np.int64)
                if len(member):
                    at = np.minimum(np.searchsorted(member, h), len(member) - 1)
                    seen = np.where(member[at] == h, often[at], 0)
                first = np.lexsort((h, seen))[: n - int(np.ceil(SIMILAR * n - 1e-9)) + 1]
                key.append(h[first])
                times.append(seen[first] * every)
                node.append(node_of(h))
                size.append(n)
                fp.append(set_print(h))
            if not key:
                continue
            i = np.repeat(np.arange(len(key)), [len(k) for k in key])
            key, times = np.concatenate(key), np.concatenate(times)
            node, size, fp = np.array(node, np.uint64), np.array(size, np.int32), np.array(fp, np.uint64)
            split, draw = 1 + times // SPLIT, mixed(node)[i]
            lead = (split > 1) & (draw.astype(np.float64) / 2.0**64 * times < LEADS)
            copies = np.where(lead, split, 1)
            row = np.repeat(np.arange(len(key)), copies)
            salt = np.where(lead[row], np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies), (draw[row] % split[row].astype(np.uint64)).astype(np.int64))
            short = (key[row] >> np.uint64(32)).astype(np.uint32)  # keys that collide add candidates only
            part = (mixed(short.astype(np.uint64) + (salt.astype(np.uint64) << np.uint64(32))) % np.uint64(n_parts)).astype(np.int64)
            yield dealt(part, dict(zip(ENTRY, (short, salt.astype(np.int32), split[row].astype(np.int32), node[i[row]], size[i[row]], fp[i[row]]))), names)

    def compared(nodes: DataFrame) -> DataFrame:
        """node, data (32 bits of each member of its set) of nodes; a bitmap of bounded size lets few other texts through."""
        need = stored(least.join(nodes.distinct(), "node").select("least.id", "least.own"), "needed")
        bits = np.zeros(1 << 22, bool)
        bits[need.select(F.pmod("own", F.lit(1 << 22)).alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
        packed = np.packbits(bits).tobytes()

        def run(batches):
            known = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
            for b in bites(batches):
                b = b.filter(pa.array(known[b.column("own").to_numpy(zero_copy_only=False) % (1 << 22)]))
                sets = [shingle_set(t) for t in texts_of(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("own"), pa.array(np.array([node_of(x) for x in sets], np.uint64).view(np.int64)), pa.array([np.unique(x.astype(np.uint32)).tobytes() for x in sets], pa.binary())], names=["id", "own", "node", "data"])

        some = texts.mapInArrow(run, "id bigint, own bigint, node bigint, data binary")
        return stored(some.join(need, ["id", "own"], "left_semi").dropDuplicates(["id", "own"]).select("node", "data"), "compared")

    def verified(pairs: DataFrame) -> DataFrame:
        # sets move only for pairs that three more fingerprints leave
        for c in ("u", "v"):
            pairs = pairs.join(least.select(F.col("node").alias(c), *(F.col(f"p{k}").alias(f"{c}{k}") for k in (1, 2, 3))), c)
        off = sum((F.bit_count(F.col(f"u{k}").bitwiseXOR(F.col(f"v{k}"))) for k in (1, 2, 3)), F.lit(0))
        pairs = stored(pairs.where(off <= FAR_MORE).select("u", "v"), "alike")

        def run(batches):
            for b in bites(batches):
                sets = ([np.frombuffer(x, np.uint32) for x in b.column(c).to_pylist()] for c in ("du", "dv"))
                keep = pa.array([jaccard(x, y) >= SIMILAR - 1e-12 for x, y in zip(*sets)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("u", "v")], names=["u", "v"])

        sets = compared(pairs.select(F.explode(F.array("u", "v")).alias("node")))
        for c in ("u", "v"):
            pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("data").alias(f"d{c}")), c)
        return stored(pairs.select("u", "v", "du", "dv").mapInArrow(run, "u bigint, v bigint"), "similar")

    def by_key(batches, key: str) -> dict[str, object] | None:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return None
        table = table.sort_by(key)
        return {c: table.column(c).to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table.column(c).to_numpy() for c in table.column_names}

    def candidates(e, key: str, *filters):
        for x, y in pairs_in(e[key], e["fp"].view(np.uint64), FAR):
            for keep in (lambda x, y: sizes_fit(e["n"][x], e["n"][y]) & (e["root"][x] != e["root"][y]), *filters):
                ok = keep(x, y)
                x, y = x[ok], y[ok]
            yield x, y

    # candidates never leave their task as pairs, whose number is the square of a group's: a key's nodes fall into the groups that candidates
    # connect, and then into those that closer comparison connects; a group that stands under many keys is one
    def across(batches):
        if e := by_key(batches, "key"):
            yield grouped_nodes(joined(len(e["node"]), candidates(e, "key")), **{c: e[c] for c in ("node", "n", "fp", "root")})

    def closer(batches):
        if e := by_key(batches, "sig"):
            near = Sketches(e["sketch"], e["size"]).near
            yield grouped_nodes(joined(len(e["node"]), candidates(e, "sig", near)), **{c: e[c] for c in ("node", "n", "fp", "root")})

    def alike(batches):
        if e := by_key(batches, "sig"):
            sets = [np.frombuffer(x, np.uint32) for x in e["data"]]
            near = Sketches([odd_sketch(x) for x in sets], np.array([len(x) for x in sets])).near
            at = np.arange(len(sets))
            for x, y in candidates(e, "sig", near):
                for i in range(0, len(x), 1_024):
                    p, q = x[i : i + 1_024], y[i : i + 1_024]
                    p, q = p[at[p] != at[q]], q[at[p] != at[q]]
                    ok = np.array([jaccard(sets[v], sets[w]) >= SIMILAR - 1e-12 for v, w in zip(p.tolist(), q.tolist())], bool)
                    if ok.any():
                        at = roots(len(at), np.concatenate([p[ok], np.arange(len(at))]), np.concatenate([q[ok], at]))
            child = np.nonzero(at != np.arange(len(at)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(e["node"][child]), pa.array(e["node"][at[child]])], names=["u", "v"])

    def sketches(batches):
        for b in bites(batches):
            sets = [np.frombuffer(x, np.uint32) for x in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(x) for x in sets], pa.int32()), pa.array([odd_sketch(x) for x in sets], pa.binary())], names=["node", "size", "sketch"])

    rows = texts.select("text").mapInArrow(spread, "part int, data binary").repartition(n_parts, "part")
    both = stored(rows.mapInArrow(meet, MET), "met")
    pairs = both.where("u IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found = verified(stored(pairs, "pairs"))
    # the rest: keys whose sets are in several classes yet
    rest = both.where("key IS NOT NULL").select("key", "node", "n", "fp").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = rest.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    rest = stored(rest.join(open_keys, "key").distinct(), "apart")
    kind = "sig bigint, node bigint, n int, fp bigint, root bigint"
    groups = stored(rest.repartition(n_parts, "key").mapInArrow(across, kind).distinct(), "groups")
    sets = compared(groups.select("node"))
    sketched = sets.mapInArrow(sketches, "node bigint, size int, sketch binary")
    groups = stored(groups.join(sketched, "node").repartition(n_parts, "sig").mapInArrow(closer, kind).distinct(), "groups")
    more = groups.join(sets, "node").repartition(n_parts, "sig").mapInArrow(alike, "u bigint, v bigint").distinct()
    return found.union(stored(more, "similar"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs(doc_id, text, ...) for each group of near-duplicates, that of the least doc_id, with all columns as they are.

    Documents are linked if their sets of shingles of five words have a Jaccard similarity of SIMILAR or more; those
    without a word are one group. Of rows equal in doc_id and text one stays.
    """

    def run(batches):
        for b in bites(batches):
            sets = [shingle_set(t) for t in texts_of(b.column("text"))]
            node = pa.array(np.array([node_of(x) for x in sets], np.uint64).view(np.int64))
            more = zip(*map(more_prints, sets)) if sets else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("own"), node, *(pa.array(list(p), pa.int64()) for p in more)], names=["id", "own", "node", "p1", "p2", "p3"])

    # within row no name of docs can clash with those used here
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own"))
    texts = keyed.select("id", "own", F.col("row.text").cast("string").alias("text"))
    nodes = texts.mapInArrow(run, "id bigint, own bigint, node bigint, p1 bigint, p2 bigint, p3 bigint")
    least = stored(nodes.groupBy("node").agg(F.min(F.struct("id", "own")).alias("least"), *(F.min(f"p{k}").alias(f"p{k}") for k in (1, 2, 3))), "classes")
    every = max(1, least.count() // SAMPLE)
    some = texts.where(F.pmod("own", F.lit(every)) == 0).mapInArrow(members, "h bigint").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(200_000).toArrow()
    h, n = (some.column(c).to_numpy() for c in ("h", "count"))
    order = np.argsort(h.view(np.uint64))
    root = components(set_links(texts, least, (h.view(np.uint64)[order], n[order]), every))
    member = least.join(root, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    stays = member.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.own").distinct()
    kept = keyed.join(stays, ["id", "own"], "left_semi")
    once = kept.withColumn("n", F.row_number().over(Window.partitionBy("id", "own").orderBy(F.lit(0)))).where("n = 1")
    return once.select("row.*")


def members(batches):
    """h: the shingles of texts."""
    for b in bites(batches):
        for t in texts_of(b.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["h"])
