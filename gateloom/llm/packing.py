"""Best-fit packing of token sequences by patterns of few lengths, fitted to the histogram of lengths.

Pieces are told apart by their length only, so a plan for the histogram (at most `size` rows, whatever the corpus) is a
plan for all of them: patterns of few lengths that fill a sequence are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares and rounded, so often as much is left; the rest is packed best fit, longest first,
again on counts. A piece finds its place by its rank among the pieces of its length; ranks are counted in salted
groups, so that a length that most pieces share isn't gathered in one task. Pieces that fill a sequence need no rank.

Cases: a null or empty text is one document of the end id alone; a null doc_id is kept; repeated rows are packed
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from gateloom.llm.common import bites, memory, stored, texts_of
from gateloom.llm.tokencount import load, tokenizer_path

#: Token ids of a sequence; patterns tried for a longest length; their pieces at most; the part of a sequence that a pattern may leave empty;
#: one of so many short pieces isn't fitted.
SIZE, TRIES, PIECES, SLACK, KEPT = 2048, 20, 7, 0.01, 8
#: Groups that a length's ranks are counted in.
SALTS = 64


class ChunkIds(dict):
    """Bytes (little-endian unsigned 32-bit ids) of the chunks between ASCII white space, as the tokenizer gives them.

    The tokenizer drops white space before it splits, and lower-cases and composes no character across it, so a
    text's ids are those of its chunks in order. Bounded: beyond `most` chunks it keeps those it has, and new ones
    only while the texts at hand need them.
    """

    #: Lower-case letters and then signs: the tokenizer always splits between the two, and its normaliser changes neither.
    STEM = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*)([!-/:-@\[-`{-~]*)")

    def __init__(self, tok, most: int = 900_000):
        super().__init__()
        self.tok, self.most, self.passing = tok, most, {}
        # the same model for words of lower-case letters: many at a time, told apart by the ids that end a word
        self.plain = Tokenizer(tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def __missing__(self, chunk: bytes) -> bytes:
        return self.passing[chunk]

    def learn(self, chunks: set[bytes]) -> None:
        self.passing = {}
        into = self if len(self) + 2 * len(chunks) <= self.most else self.passing
        stems, signs, both, rest = set(), set(), [], []
        for c in chunks:
            if m := self.STEM.fullmatch(c):
                x, y = m.groups()
                if x and y:
                    both.append((c, x, y))
                (stems if x else signs).add(x or y)
                if x and y:
                    signs.add(y)
            else:
                rest.append(c)
        rest += [c for c in signs if c not in self]
        stems = [c for c in stems if c not in self]
        for a in range(0, len(stems), 5_000):
            part = stems[a : a + 5_000]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cut, data, at = (4 * np.nonzero(self.ends[ids])[0] + 4).tolist(), ids.tobytes(), 0
            for c, end in zip(part, cut, strict=True):
                into[c] = data[at:end]
                at = end
        for a in range(0, len(rest), 20_000):
            part = rest[a : a + 20_000]
            for c, e in zip(part, self.tok.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in part], add_special_tokens=False), strict=True):
                into[c] = array("I", e.ids).tobytes()
        for c, x, y in both:
            into[c] = self[x] + self[y]

    def of(self, texts: list[str]) -> list[bytes]:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        # the tokenizer lower-cases all but its special tokens, which are written with <|
        split = [(t if b"<|" in t else t.lower()).split() for t in data]
        gc.disable()  # nothing here is cyclic, and the lists of ids would set it off again and again
        self.learn({c for c in set().union(*split) if c not in self})
        gc.enable()
        return [b"".join(map(self.__getitem__, words)) for words in split]


def chunk_ids(path: str) -> ChunkIds:
    """One memory of chunks for each Python worker."""
    return memory(f"chunks {path}", lambda: ChunkIds(load(path)))


def groups_of(texts: list[str], chars: int = 4_000_000):
    """Runs of texts of about so many characters together."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", size: int = SIZE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and then the end id, cut only beyond `size`."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids_of = chunk_ids(tokenizer_path(vocabulary))
        end = array("I", [end_id]).tobytes()
        for b in bites(batches, 1024):
            doc, piece, start, length, crc = [], [], [], [], []
            i = 0
            for part in groups_of(texts_of(b.column("text"))):
                for ids in ids_of.of(part):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[a : a + 4 * size]
                        doc.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                    i += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(have: np.ndarray, size: int = SIZE, tries: int = TRIES, most: int = PIECES, seed: int = 3) -> list[tuple[int, ...]]:
    """Patterns of up to `most` lengths, longest first. have: how often each length occurs.

    For each length as the longest: `tries` patterns whose next pieces are drawn as the histogram has them, and whose last one
    fills the sequence exactly, or as nearly as a length can; of these also the two-piece one.
    """
    asc = np.nonzero(have)[0]
    if not len(asc):
        return []
    rng = np.random.default_rng(seed)
    cum = np.cumsum(have[asc], dtype=np.float64)
    # number of lengths up to each room
    upto = np.searchsorted(asc, np.arange(size + 1), "right")
    longest = np.repeat(asc, tries)
    k = np.tile(np.arange(tries) % (most - 1), len(asc))  # pieces drawn between the first and the last
    taken, room = [longest], size - longest
    for i in range(most - 2):
        can = upto[np.minimum(room, longest)]
        draw = rng.random(len(room)) * np.where(can > 0, cum[np.maximum(can, 1) - 1], 0)
        y = np.where((can > 0) & (i < k), asc[np.minimum(np.searchsorted(cum, draw, "right"), np.maximum(can, 1) - 1)], 0)
        taken.append(y)
        room = room - y
    for _ in range(2):
        can = upto[np.minimum(room, longest)]
        z = np.where(can > 0, asc[np.maximum(can, 1) - 1], 0)
        taken.append(z)
        room = room - z
    rows = -np.sort(-np.stack(taken, axis=1), axis=1)
    return sorted({tuple(x for x in r if x) for r in rows.tolist()}, reverse=True)


def fitted(have: np.ndarray, found: list[tuple[int, ...]], size: int = SIZE, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - have|^2, A counting lengths in patterns: accelerated projected gradient."""
    rows = np.array([x for p in found for x in p], np.int64)
    cols = np.repeat(np.arange(len(found)), [len(p) for p in found])
    # no eigenvalue of A'A is above the greatest sum of a column of |A| times that of a row
    step = 1.0 / max(1.0, float(np.bincount(rows, minlength=size + 1).max()) * max(map(len, found), default=1))
    x = y = np.zeros(len(found))
    t = 1.0
    target = have.astype(float)
    for _ in range(rounds):
        r = np.bincount(rows, y[cols], size + 1) - target
        nxt = np.maximum(0, y - step * np.bincount(cols, r[rows], len(found)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def best_fit(left: np.ndarray, size: int = SIZE, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal bins and equal lengths are handled together. begun: sequences that may have room."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(p: tuple[int, ...], n: int, room: int) -> None:
        (bins.setdefault(room, []) if room else done).append((p, n))

    for p, n in begun:
        put(p, n, size - sum(p))
    for x in range(size, 0, -1):
        n = int(left[x])
        while n:
            room = min((r for r in bins if r >= x), default=None)
            if room is None:
                per = size // x
                if n >= per:
                    put((x,) * per, n // per, size - per * x)
                if n % per:
                    put((x,) * (n % per), 1, size - n % per * x)
                break
            group = bins[room]
            p, k = group.pop()
            m = min(n, k)
            if k > m:
                group.append((p, k - m))
            if not group:
                del bins[room]
            put((*p, x), m, room - x)
            n -= m
    return done + [g for group in bins.values() for g in group]


def rounded(x: np.ndarray, found: list[tuple[int, ...]], have: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts: those of patterns with one longest piece keep their sum, and no length is used more often than it occurs."""
    left, out = have.astype(np.int64).copy(), []
    first = np.array([p[0] for p in found])
    total = np.concatenate([np.round(np.cumsum(x[first == v])) for v in dict.fromkeys(first.tolist())])
    start = np.r_[True, first[1:] != first[:-1]]
    whole = np.where(start, total, np.diff(np.r_[0.0, total])).astype(np.int64)
    for i in np.argsort(-x, kind="stable").tolist():
        times = Counter(found[i])
        n = min([int(whole[i]), *(int(left[v]) // c for v, c in times.items())])
        if n > 0:
            out.append((found[i], n))
            for v, c in times.items():
                left[v] -= n * c
    return out


def plan(have: np.ndarray, size: int = SIZE, rounds: int = 6) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that together use each length as often as have says: patterns fitted and rounded, again on what is left, then best fit."""
    left, out = have.astype(np.int64).copy(), []
    # some short pieces are kept for the room that residuals leave
    kept = np.where(np.arange(size + 1) <= size // 8, left // KEPT, 0)
    left -= kept
    for k in range(rounds):
        found = patterns(left, size, seed=3 + k)
        took = rounded(fitted(left, found, size), found, left) if found else []
        # a pattern that wastes much is left to best fit
        took = [(p, n) for p, n in took if size - sum(p) <= SLACK * size]
        if not took:
            break
        for p, n in took:
            for v in p:
                left[v] -= n
        out += took
    return best_fit(left + kept, size, out)


def pack(cut: DataFrame, size: int = SIZE, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to the rows of cut(doc_id, piece, length, ...); no sequence holds more than size."""
    spark = cut.sparkSession
    whole = stored(cut, "cut")
    full = whole.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    cut = whole.where(F.col("length") != size)
    cut = (cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    # at most size x salts rows, however long the table
    counted = cut.groupBy("length", "_salt").count().collect()
    have = np.zeros(size + 1, np.int64)
    for r in counted:
        have[r["length"]] += r["count"]
    before: dict[tuple[int, int], int] = {}
    at = np.zeros(size + 1, np.int64)
    for r in sorted(counted, key=lambda r: (r["length"], r["_salt"])):
        before[r["length"], r["_salt"]] = int(at[r["length"]])
        at[r["length"]] += r["count"]
    at[:] = 0
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for p, n in plan(have, size):
        offset = 0
        for x in p:
            runs.setdefault(x, []).append((int(at[x]), base, offset))
            at[x] += n
            offset += x
        base += n
    first = spark.createDataFrame([(a, b, n) for (a, b), n in before.items()], "length bigint, _salt int, _before bigint")
    spots = spark.createDataFrame([(x, *map(list, zip(*r, strict=True))) for x, r in runs.items()], "length bigint, _from array<bigint>, _base array<bigint>, _offset array<bigint>")
    ranked = cut.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(F.broadcast(first), ["length", "_salt"]).join(F.broadcast(spots), "length").withColumn("_rank", F.col("_before") + F.col("_n"))
    ranked = ranked.withColumn("_k", F.size(F.filter("_from", lambda x: x <= F.col("_rank"))) - 1)
    placed = ranked.select(
        *[c for c in cut.columns if c != "_salt"],
        (F.get("_base", "_k") + F.col("_rank") - F.get("_from", "_k")).alias("sequence_id"),
        F.get("_offset", "_k").alias("offset"),
    )
    return placed.union(full)


def packed(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", size: int = SIZE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs(doc_id, text)."""
    return pack(pieces(docs, vocabulary, size, end_id), size)
