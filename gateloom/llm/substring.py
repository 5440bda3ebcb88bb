"""Removal of passages that earlier documents hold, by suffix automata of sharded reference passages.

Sending an automaton of every shard to every document would cost the square of the corpus. Instead each document is
cut at content-defined anchors: of the SPAN - K + 1 runs of K words in a window of SPAN words, the one of least hash is the
window's anchor, so equal windows have equal anchors wherever they stand. Windows whose anchor stands in one document
only can't repeat. The others travel, as runs of words around their anchor, to the shard of the anchor; there, in order
of doc_id, each run is streamed through the shard's suffix automaton of the runs of lesser doc_ids, which gives for
each word the longest match that ends there (matching statistics); where it is SPAN words or more, the window
repeats. Then the run is added. A run that was seen word for word isn't added again, only answered, so groups of
copies cost one step each. A shard's automaton holds distinct words, not hashes: the answer is exact.

Anchors are pre-aggregated in each task before they are shuffled, and the text is shuffled once (both joins read the same
exchange). Shards hold SHARD_RUNS runs or so: their number grows with the input.

Cases: a null or empty text has no word, and keeps none; a document of fewer than SPAN words loses none; equal or null
doc_ids: only a smaller doc_id removes, so rows of equal doc_id never remove each other, null is smaller than all;
repeated rows each get their row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from gateloom.llm.common import WordHashes, ascii_words, blocked, blocks_of, memory, mixed, opened, shards, texts_of

#: Words of a window; words of an anchor.
SPAN, K = 13, 5
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """A suffix automaton over words, built online; several sequences may be added, each read on its own."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.last = 0

    def start(self) -> None:
        self.last = 0

    def add(self, word) -> None:
        nxt, link, length = self.next, self.link, self.len
        p = self.last
        if (q := nxt[p].get(word)) is not None:  # the state is there already, as in any automaton of several sequences
            if length[q] == length[p] + 1:
                self.last = q
                return
            self.last = self._split(p, q, word)
            return
        cur = len(length)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        self.last = cur

    def _split(self, p: int, q: int, word) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = new
            p = link[p]
        return new

    def matching(self, words) -> list[int]:
        """For each word the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.len
        at = n = 0
        out = []
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                n = length[at]
            if w in nxt[at]:
                at = nxt[at][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def anchors(h: np.ndarray, span: int = SPAN, k: int = K) -> np.ndarray:
    """The anchor (hash of its k words) of the window that starts at each word; h are the words' hashes."""
    n = len(h) - k + 1
    if len(h) < span:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * _MUL + h[j : j + n]
    g = mixed(g)
    low = g[: n - (span - k)].copy()
    for j in range(1, span - k + 1):
        np.minimum(low, g[j : j + len(low)], out=low)
    return low




def hashes_of(words: list[bytes]) -> np.ndarray:
    return memory("hashes 0", WordHashes).of(words)


def kept_words(words: list[bytes], s: np.ndarray | None, span: int = SPAN) -> list[bytes]:
    """The words that no window at s covers."""
    if s is None:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, s, 1)
    np.add.at(cover, s + span, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def shared_anchors(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """block, shared: sorted anchors (packed 64-bit integers) of a block's documents that also stand in a document of another id.

    A block's anchors go to their buckets as packed sorted arrays with the least and greatest id that each stands in.
    """
    n = shards(docs.sparkSession)

    def gather(batches):
        for block, rows in blocks_of(batches):
            parts = []
            for doc, t in zip(rows.column("id").to_pylist(), texts_of(rows.column("text"))):
                own = anchors(hashes_of(ascii_words(t)), span, k)
                if len(own):
                    own = np.unique(own)
                    parts.append((own, np.full(len(own), doc, np.int64)))
            if not parts:
                continue
            a, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            first = np.nonzero(np.r_[True, a[1:] != a[:-1]])[0]
            a, low, high = a[first], d[first], d[np.r_[first[1:] - 1, len(d) - 1]]
            bucket = (a % np.uint64(n)).astype(np.int32)
            for i in np.unique(bucket):
                own = bucket == i
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([i], pa.int32()), *(pa.array([x[own].tobytes()], pa.binary()) for x in (a, low, high))], names=["block", "bucket", "a", "low", "high"])

    def answer(batches):
        held: dict[int, list] = {}
        for b in batches:
            for block, bucket, *x in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(bucket, []).append((block, np.frombuffer(x[0], np.uint64), np.frombuffer(x[1], np.int64), np.frombuffer(x[2], np.int64)))
        for parts in held.values():
            a, low, high = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            u, inv = np.unique(a, return_inverse=True)
            least, most = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
            np.minimum.at(least, inv, low)
            np.maximum.at(most, inv, high)
            both = (least < most)[inv]
            at = 0
            for block, own, *_ in parts:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own[both[at : at + len(own)]].tobytes()], pa.binary())], names=["block", "shared"])
                at += len(own)

    asked = docs.mapInArrow(gather, "block int, bucket int, a binary, low binary, high binary")
    return asked.repartition(n, "bucket").mapInArrow(answer, "block int, shared binary")


def runs_of(a: np.ndarray, shared: np.ndarray) -> list[tuple[int, int]]:
    """(first window, last window + 1) of each run of windows with one anchor that is among the sorted shared ones."""
    if not len(a) or not len(shared):
        return []
    at = np.searchsorted(shared, a)
    at[at == len(shared)] = 0
    hit = shared[at] == a
    edge = np.nonzero(np.r_[True, a[1:] != a[:-1]])[0]
    end = np.r_[edge[1:], len(a)]
    return [(s, e) for s, e, h in zip(edge.tolist(), end.tolist(), hit[edge].tolist()) if h]


def routed(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """anchor, id, block, start, words: the runs of words that may repeat."""
    shared = shared_anchors(docs, span, k)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in answers.column("shared").to_pylist())]))
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for block, doc, t in ((block, *x) for block, docs_ in blocks_of([rows]) for x in zip(docs_.column("id").to_pylist(), texts_of(docs_.column("text")))):
            words = ascii_words(t)
            a = anchors(hashes_of(words), span, k)
            if found := runs_of(a, known):
                own = hash_of(t)
                for s, e in found:
                    for x, v in zip(out, (int(a[s].view(np.int64)), doc, block, own, s, b" ".join(words[s : e + span - 1])), strict=True):
                        x.append(v)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "id", "block", "own", "start", "words"])

    return docs.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, "anchor bigint, id bigint, block int, own bigint, start int, words binary")


def hash_of(text: str) -> int:
    """Tells texts of one id apart."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


class Shard:
    """The reference passages of one anchor, with the documents' runs streamed through their automaton in order of id."""

    def __init__(self, span: int):
        self.span, self.seen, self.waiting, self.auto = span, set(), [], None

    def starts(self, run: bytes) -> list[int]:
        """Windows of a run that also start in the passages so far."""
        if run in self.seen:
            return list(range(run.count(b" ") + 2 - self.span))
        if not self.seen:
            return []
        if self.auto is None:
            self.auto = Automaton()
        for x in self.waiting:  # passages enter the automaton only when another run is to be matched
            self.auto.start()
            for w in x.split(b" "):
                self.auto.add(w)
        self.waiting = []
        return [i + 1 - self.span for i, n in enumerate(self.auto.matching(run.split(b" "))) if n >= self.span]

    def add(self, run: bytes) -> None:
        if run not in self.seen:
            self.seen.add(run)
            self.waiting.append(run)


def repeated(runs: DataFrame, span: int = SPAN) -> DataFrame:
    """block, id, own, start: windows that also start in a document of smaller id."""
    n = shards(runs.sparkSession)

    def run(batches):
        anchor, shard, now, todo = None, None, None, []
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for a, doc, block, own, start, words in zip(*(c.to_pylist() for c in b.columns)):
                if a != anchor:
                    anchor, shard, now, todo = a, Shard(span), doc, []
                elif doc != now:  # runs of one id are added together, after all of them were matched
                    for x in todo:
                        shard.add(x)
                    now, todo = doc, []
                for i in shard.starts(words):
                    for x, v in zip(out, (block, doc, own, start + i), strict=True):
                        x.append(v)
                todo.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["block", "id", "own", "start"])

    return runs.repartition(n, "anchor").sortWithinPartitions("anchor", "id").select("anchor", "id", "block", "own", "start", "words").mapInArrow(run, "block int, id bigint, own bigint, start int")


def without_repeats(docs: DataFrame, span: int = SPAN, k: int = K, text_too: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text that stays, if asked) for each row of docs(doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = blocked(docs, "doc_id")
    found = repeated(routed(rows, span, k), span)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        doc, own, start = (answers.column(c).to_numpy() for c in ("id", "own", "start"))
        order = np.lexsort((start, own, doc))
        doc, own, start = doc[order], own[order], start[order]
        edge = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])])[0] if len(doc) else np.zeros(0, np.int64)
        at = {(d, o): (s, e) for d, o, s, e in zip(doc[edge].tolist(), own[edge].tolist(), edge.tolist(), np.r_[edge[1:], len(doc)].tolist())}
        ids = set(doc[edge].tolist())
        n, gone, sha, kept = [], [], [], []
        rows = opened(rows.column("data").to_pylist())
        if rows is None:
            return empty
        for i, t in zip(rows.column("id").to_pylist(), texts_of(rows.column("text"))):
            words = ascii_words(t)
            s = at.get((i, hash_of(t))) if i in ids else None
            left = kept_words(words, np.unique(start[s[0] : s[1]]) if s else None, span)
            stays = b" ".join(left)
            n.append(len(words))
            gone.append(len(words) - len(left))
            sha.append(hashlib.sha256(stays).hexdigest())
            if text_too:
                kept.append(stays.decode("utf-8", "surrogatepass"))
        cols = [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
        return pa.table(cols + [pa.array(kept, pa.string())] * text_too, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text_too)

    arrow_type = to_arrow_type(docs.schema["doc_id"].dataType)
    empty = pa.table([pa.array([], arrow_type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())] + [pa.array([], pa.string())] * text_too, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text_too)
    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * text_too
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)
