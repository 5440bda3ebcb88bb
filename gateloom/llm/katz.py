"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, tables partitioned by hash.

Documents are dealt into blocks by hash. The model's tables are partitioned into buckets by the hash of the context, and
never gathered anywhere: each block asks each bucket once for the n-grams that its documents hold, as packed sorted arrays
that carry the block's own counts, and a bucket answers with the totals, in the same order. So what moves are distinct
n-grams of blocks, not tokens. First come single tokens (their counts also say which contexts are hot), then pairs:

* count of the pair, in training documents, over the corpus;
* of the context: its count, how many of its pairs occur r times (r up to K), the count of the others, and the sum of
  the single-token weights of the words seen after it.

From these a block has Katz' model for its tokens, recursively: P(w | h) = d(c) c(h, w) / c(h) for a pair that was seen,
else alpha(h) P(w), where P(w) = (c(w) + 1) / (N + V + 1) and alpha(h) gives the words not seen after h exactly the mass
that the discounts took from those seen. d follows Good and Turing for counts up to K (an absolute discount where the
counts of counts don't allow that). A context all of whose counts are above K keeps 1 / (c(h) + 1) for unseen words. A
context that more than SALT_TOKENS tokens have is split into parts by its words' hashes, so no bucket gets all of it.

Cases: a null or empty text is its end token alone; a null doc_id counts as held out; repeated rows count and are scored each; with
nothing to learn from, all tokens are equally improbable; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gateloom.llm.common import WordHashes, ascii_words, blocked, blocks_of, forget, lean, memory, mixed, opened, shards, texts_of

#: Counts up to this are discounted; tokens of a context beyond which it is split; folds and the one held out.
K, SALT_TOKENS, FOLDS, HELD = 5, 4_000_000, 7, 2
#: Bytes of a word's hash that tell it from the others after the same context.
WIDE = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
ANSWER = "block int, level int, bucket int, x0 binary, x1 binary"


def hashes_of(words: list[bytes]) -> np.ndarray:
    return memory("hashes 1", lambda: WordHashes(seed=1)).of(words)


#: White space can't be in a word, so these are nobody's hashes but the end's and the beginning's.
END, BEGIN = (hashes_of([x])[0] for x in (b"\n", b"\r"))


def pack(x: np.ndarray, width: int = 8) -> bytes:
    """64-bit integers as bytes, all first bytes first: planes of zeros compress away."""
    return np.ascontiguousarray(x.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def unpack(data: bytes, width: int = 8) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


class Block:
    """The tokens of some documents, their distinct words and pairs."""

    def __init__(self, rows: pa.Table):
        held = rows.column("held_out").to_pylist()
        docs = [np.append(hashes_of(ascii_words(t, lower=True)), END) for t in texts_of(rows.column("text"))]
        forget()  # hashes of words aren't needed beside the arrays that follow
        self.size = np.fromiter(map(len, docs), np.int64, len(docs))
        docs.append(np.array([BEGIN], np.uint64))
        flat = np.concatenate(docs)
        del docs
        self.ids, inv = np.unique(flat, return_inverse=True)
        del flat
        self.begin, self.token = int(inv[-1]), inv[:-1].astype(np.int32)
        del inv
        self.train = np.repeat(~np.array(held, bool), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.count = np.bincount(self.token[self.train], minlength=len(self.ids))
        self.count[self.begin] = int((~np.array(held, bool)).sum())

    def pairs(self, total: np.ndarray) -> None:
        """Pairs in the order of (part of a context, word); total has the words' counts over the corpus."""
        n = np.uint64(len(self.ids))
        before = np.r_[self.begin, self.token[:-1]]
        before[self.first] = self.begin
        key = before.astype(np.uint64) * n
        del before
        key += self.token.astype(np.uint64)
        pair, inv = np.unique(key, return_inverse=True)
        self.pair_of_token = inv.astype(np.int32)
        del key, inv
        count = np.bincount(self.pair_of_token[self.train], minlength=len(pair))
        ctx, word = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
        del pair
        # parts: one for each context, more for a hot one, whether or not the block has words in all of them
        own = np.unique(ctx)
        at = np.searchsorted(own, ctx).astype(np.int32)
        del ctx
        salts = 1 + total[own].astype(np.int64) // SALT_TOKENS
        base = np.cumsum(salts) - salts
        self.part_ctx = np.repeat(np.arange(len(own)), salts)
        sub = np.arange(int(salts.sum())) - base[self.part_ctx]
        part = base[at]
        hot = np.nonzero(salts[at] > 1)[0]
        part[hot] += (mixed(self.ids[word[hot]]) % salts[at[hot]].astype(np.uint64)).astype(np.int64)
        del hot
        name = self.ids[own][self.part_ctx]
        name = np.where(sub == 0, name, mixed(name + sub.astype(np.uint64) * _MUL))
        order = np.argsort(name, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.name, self.part_ctx = name[order], self.part_ctx[order]
        part = rank[part]
        self.part_size = np.bincount(part, minlength=len(order))
        by = np.argsort(part.astype(np.uint64) * n + word.astype(np.uint64), kind="stable")
        del part
        self.ctx, self.word, self.pair_count = at[by], word[by], count[by].astype(np.int32)
        del at, word, count
        back = np.empty(len(by), np.int32)
        back[by] = np.arange(len(by), dtype=np.int32)
        self.pair_of_token = back[self.pair_of_token]
        self.contexts = len(own)


def bucket_edges(sorted_hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to): buckets are equal ranges of the hash, so a sorted array falls into slices."""
    bucket = ((sorted_hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    edge = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1]])[0] if len(bucket) else np.zeros(0, np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edge, np.r_[edge[1:], len(bucket)])]


def batch(names: list[str], *rows) -> pa.RecordBatch:
    types = {"block": pa.int32(), "level": pa.int32(), "bucket": pa.int32()}
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), types.get(n, pa.binary())) for n, c in zip(names, cols, strict=True)], names=names)


def by_bucket(batches) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for b in batches:
        for bucket, *rest in zip(*(c.to_pylist() for c in b.columns)):
            out.setdefault(bucket, []).append(rest)
    return out


def word_answers(rows: DataFrame, n: int) -> DataFrame:
    """Counts of single tokens over the corpus, for each block in the order of its words; and N and V in parts."""

    def ask(batches):
        lean()
        for block, rows in blocks_of(batches):
            own = Block(rows)
            for bucket, a, b in bucket_edges(own.ids, n):
                yield batch(["bucket", "block", "x0", "x1"], (bucket, block, pack(own.ids[a:b]), pack(own.count[a:b])))

    def answer(batches):
        lean()
        for bucket, parts in by_bucket(batches).items():
            ids = [unpack(x) for _, x, _ in parts]
            u, inv = np.unique(np.concatenate(ids), return_inverse=True)
            total = np.zeros(len(u), np.int64)
            np.add.at(total, inv, np.concatenate([unpack(x) for *_, x in parts]).astype(np.int64))
            words = total[u != BEGIN]
            stats = pack(np.array([words.sum(), (words > 0).sum()]))
            at = 0
            for (block, *_), own in zip(parts, ids, strict=True):
                yield batch(["block", "level", "bucket", "x0", "x1"], (block, 1, bucket, pack(total[inv[at : at + len(own)]]), b""))
                at += len(own)
            yield batch(["block", "level", "bucket", "x0", "x1"], *((j, 0, bucket, stats, b"") for j in range(n)))

    asked = rows.mapInArrow(ask, "bucket int, block int, x0 binary, x1 binary")
    return asked.repartition(n, "bucket").mapInArrow(answer, ANSWER)


def joined(answers: pa.Table, level: int) -> list[tuple[bytes, bytes]]:
    got = sorted((b, x, y) for lv, b, x, y in zip(*(answers.column(c).to_pylist() for c in ("level", "bucket", "x0", "x1"))) if lv == level)
    return [(x, y) for _, x, y in got]


def known_words(answers: pa.Table) -> tuple[np.ndarray, int, int]:
    """Counts of the block's words over the corpus, N and V."""
    total = np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x, _ in joined(answers, 1))]).astype(np.int64)
    n = sum((unpack(x).astype(np.int64) for x, _ in joined(answers, 0)), np.zeros(2, np.int64))
    return total, int(n[0]), int(n[1])


def pair_answers(rows: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Totals of the blocks' pairs and of their contexts, in the blocks' order; and counts of counts in parts."""
    names = ["bucket", "block", "x0", "x1", "x2", "x3", "x4"]

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        out = []
        for block, rows in blocks_of([table]):
            own = Block(rows)
            total = known_words(answers)[0]
            own.pairs(total)
            ends = np.cumsum(own.part_size)
            for bucket, a, b in bucket_edges(own.name, n):
                p, q = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
                w = own.word[p:q]
                out.append((bucket, block, pack(own.name[a:b]), pack(own.part_size[a:b]), pack(own.ids[w], WIDE), pack(own.pair_count[p:q]), pack(total[w])))
        return pa.Table.from_batches([batch(names, *out)])

    def answer(batches):
        lean()
        for bucket, parts in by_bucket(batches).items():
            blocks = [p[0] for p in parts]
            name, size, word, count, weight = ([unpack(p[i], WIDE if i == 3 else 8) for p in parts] for i in range(1, 6))
            lengths = [len(x) for x in name]
            grams = [len(x) for x in word]
            parts.clear()
            name, size, word = np.concatenate(name), np.concatenate(size).astype(np.int64), np.concatenate(word)
            count, weight = np.concatenate(count).astype(np.int64), np.concatenate(weight).astype(np.int64)
            u, ctx = np.unique(name, return_inverse=True)
            o = np.repeat(ctx, size)
            del name, size
            order = np.lexsort((word, o))
            o, w = o[order], word[order]
            del word
            new = np.r_[True, (o[1:] != o[:-1]) | (w[1:] != w[:-1])] if len(o) else np.zeros(0, bool)
            del w
            group = np.cumsum(new) - 1
            total = np.zeros(int(new.sum()), np.int64)
            np.add.at(total, group, count[order])
            c, weights = o[new], weight[order[new]] + 1
            del o, new, count, weight
            stats = np.zeros((K + 3, len(u)), np.int64)
            for i, (mask, add) in enumerate([(total > 0, total), *((total == r, 1) for r in range(1, K + 1)), (total > K, total), (total > 0, weights)]):
                np.add.at(stats[i], c[mask], add[mask] if isinstance(add, np.ndarray) else add)
            each = np.empty(len(order), np.int64)
            each[order] = total[group]
            del order, group
            of_counts = pack(np.array([(total == r).sum() for r in range(1, K + 2)]))
            at = part = 0
            for block, names_, pairs in zip(blocks, lengths, grams, strict=True):
                yield batch(["block", "level", "bucket", "x0", "x1"], (block, 2, bucket, pack(each[at : at + pairs]), pack(stats[:, ctx[part : part + names_]].reshape(-1))))
                at += pairs
                part += names_
            yield batch(["block", "level", "bucket", "x0", "x1"], *((j, 3, bucket, of_counts, b"") for j in range(n)))

    asked = rows.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(ask, "bucket int, block int, x0 binary, x1 binary, x2 binary, x3 binary, x4 binary")
    return asked.repartition(n, "bucket").mapInArrow(answer, ANSWER)


def discounts(n: np.ndarray) -> np.ndarray:
    """d(1) to d(K) from the counts of counts n[0] (once) to n[K] (K + 1 times)."""
    r = np.arange(1, K + 1)
    n = n.astype(float)
    absolute = (r - (n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5)) / r
    absolute = np.clip(absolute, 0.05, 0.99)
    if (n <= 0).any() or (K + 1) * n[K] >= n[0]:
        return absolute
    common = (K + 1) * n[K] / n[0]
    d = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common)
    return np.where((d > 0) & (d < 1), d, absolute)


def backoff(stats: np.ndarray, d: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: what seen pairs' discounted counts are divided by, and alpha. whole is N + V + 1."""
    total = stats[0].astype(float)
    kept = stats[6].astype(float) + (stats[1 : K + 1] * (d * np.arange(1, K + 1))[:, None]).sum(axis=0)
    full = stats[1 : K + 1].sum(axis=0) == 0  # no count is discounted
    over = np.where(full, total + 1, np.maximum(total, 1))
    left = np.where(total > 0, 1 - kept / over, 1.0)
    return over, np.where(total > 0, left / (1 - stats[7] / whole), 1.0)


def katz_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text)."""
    n = shards(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(True))
    rows = blocked(docs.select("doc_id", "text", held.alias("held_out")), "doc_id", "held_out")
    words = word_answers(rows, n)
    pairs = pair_answers(rows, words, n)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        lean()
        table = opened(table.column("data").to_pylist())
        if table is None:
            return empty
        own = Block(table)
        total, tokens, distinct = known_words(answers)
        own.pairs(total)
        whole = tokens + distinct + 1
        got = joined(answers, 2)
        count = np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x, _ in got)]).astype(np.int64)
        parts = np.concatenate([np.zeros((K + 3, 0), np.int64), *(unpack(y).astype(np.int64).reshape(K + 3, -1) for _, y in got)], axis=1)
        stats = np.zeros((K + 3, own.contexts), np.int64)
        for i in range(K + 3):
            np.add.at(stats[i], own.part_ctx, parts[i])
        d = np.r_[1.0, discounts(sum((unpack(x).astype(np.int64) for x, _ in joined(answers, 3)), np.zeros(K + 1, np.int64)))]
        over, alpha = backoff(stats, d[1:], whole)
        single = (total + 1) / whole
        seen = count * np.where(count <= K, d[np.minimum(count, K)], 1.0) / over[own.ctx]
        p = np.log10(np.where(count > 0, seen, alpha[own.ctx] * single[own.word]))
        sums = lambda x: np.add.reduceat(x, own.first) if len(own.first) else x[:0]
        known = (total > 0).astype(np.int64)[own.token]
        return pa.table(
            [table.column("doc_id"), table.column("held_out"), pa.array(own.size), pa.array(sums(known)), pa.array(np.full(len(table), tokens)), pa.array(sums(np.log10(single)[own.token])), pa.array(sums(p[own.pair_of_token]))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    empty = pa.table([pa.array([], t) for t in types], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.groupBy("block").cogroup(words.unionByName(pairs).groupBy("block")).applyInArrow(run, schema)
