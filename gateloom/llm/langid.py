"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A model gives the probability of each letter of a word after up to ORDER - 1 letters of the same word (a word is the
letters of a chunk between white space, lower-cased, with a mark before and after). All languages share sorted arrays
of n-gram hashes; beside each hash stand its counts by language. A document gets the language whose model gives the
least cross-entropy per symbol. Rejection is calibrated on labelled documents that no model was trained on: a
document is rejected if its least cross-entropy lies far above what documents of that language have, given its length.

Learning takes a bounded sample: at most SAMPLE_DOCS documents a language, chosen by hash among labelled ones with
crc32(doc_id) mod 5 != 0 (those with remainder 1 calibrate, the others train).

Cases: a null text or one without a letter is `und` with score 0 and rejected; with nothing to learn from, all are
`und`; a null doc_id counts as held out; a null lang is never learned; repeated rows each get their row; an empty
table gives an empty table; other columns are ignored, or kept by accepted().
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gateloom.llm.common import bites, lean, memory, mixed, texts_of

#: Longest n-gram; labelled documents of a language that are learned from, at most; folds.
ORDER, SAMPLE_DOCS, FOLDS = 5, 1200, 5
#: Rejected from so many standard errors, and so many nats a symbol, above the calibrated mean on.
REJECT_SE, REJECT_NATS = 8.0, 0.7
#: Nats a symbol that make a language e times as likely as another in the score.
SHARPNESS = 12.0
_MUL = np.uint64(0x9E3779B97F4A7C15)


def letters(chunk: bytes) -> str:
    return "".join(filter(str.isalpha, chunk.decode("utf-8", "surrogatepass").lower()))


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ^word$ for all words in a row, each one's place in its word, and the place of each word's ^."""
    text = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    first = np.cumsum(size) - size
    return code, np.arange(len(code)) - np.repeat(first, size), first


def grams(code: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols that end at each place; 0 where the word has fewer before it."""
    h = np.full(len(code), np.uint64(k))
    for j in range(k - 1, -1, -1):
        h[j:] = mixed(h[j:] * _MUL + code[: len(code) - j])
    h[place < k - 1] = 0
    return h


@dataclass
class Level:
    """One order: sorted hashes of grams and of their contexts, and by language the counts and the discount."""

    gram: np.ndarray
    count: np.ndarray
    context: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    discount: np.ndarray


def find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The places of x in a sorted array; the length of the array (a row of zeros there) where it isn't."""
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return np.where(sorted_[at] == x, at, len(sorted_)) if len(sorted_) else np.zeros(len(x), np.int64)


@dataclass
class Model:
    langs: list[str]
    levels: list[Level] = field(default_factory=list)
    alphabet: int = 1
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None

    def log_probs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: log-probability by language, and the number of symbols."""
        code, place, first = symbols(words)
        p = np.full((len(code), len(self.langs)), 1.0 / (self.alphabet + 1))
        before = np.zeros(len(code), np.uint64)
        for k, level in enumerate(self.levels, 1):
            here = place >= max(1, k - 1)
            gram = grams(code, place, k)
            context = before if k > 1 else np.ones(len(code), np.uint64)
            c, j = level.count[find(level.gram, gram[here])], find(level.context, np.roll(context, 1)[here] if k > 1 else context[here])
            total, kinds = level.total[j], level.kinds[j]
            lower = p[here]
            with np.errstate(invalid="ignore", divide="ignore"):
                p[here] = np.where(total > 0, (np.maximum(c - level.discount, 0) + level.discount * kinds * lower) / total, lower)
            before = gram
        logs = np.log(p)
        logs[place == 0] = 0
        return np.add.reduceat(logs, first, axis=0) if len(words) else np.zeros((0, len(self.langs))), np.fromiter((len(w) + 1 for w in words), np.int64, len(words))


def train(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """A model from word counts by language."""
    langs = sorted(counts)
    model = Model(langs)
    per = []
    for lang in langs:
        words = sorted(w for w in counts[lang] if w)
        code, place, _ = symbols(words)
        weight = np.repeat(np.array([counts[lang][w] for w in words], float), [len(w) + 2 for w in words])
        hashes = [grams(code, place, k) for k in range(1, order + 1)]
        model.alphabet = max(model.alphabet, len(np.unique(code)))
        rows = []
        for k in range(1, order + 1):
            ok = place >= max(1, k - 1)
            g = hashes[k - 1]
            ctx = np.roll(hashes[k - 2], 1) if k > 1 else np.ones(len(g), np.uint64)
            u, at, inv = np.unique(g[ok], return_index=True, return_inverse=True)
            n = np.bincount(inv, weight[ok], len(u))
            if k < order:  # continuation counts, but for grams that begin a word
                longer = place >= k
                pairs, one = np.unique(hashes[k][longer], return_index=True)
                kinds = np.bincount(np.searchsorted(u, g[longer][one]), minlength=len(u)).astype(float)
                n = np.where(place[ok][at] == k - 1, n, kinds) if k > 1 else kinds
            rows.append((u, n, ctx[ok][at]))
        per.append(rows)
    for k in range(order):
        gram = np.unique(np.concatenate([r[k][0] for r in per])) if per else np.zeros(0, np.uint64)
        context = np.unique(np.concatenate([r[k][2] for r in per])) if per else np.zeros(0, np.uint64)
        count = np.zeros((len(gram) + 1, len(langs)), np.float32)
        total, kinds = (np.zeros((len(context) + 1, len(langs)), np.float32) for _ in range(2))
        discount = np.zeros(len(langs))
        for i, rows in enumerate(per):
            u, n, ctx = rows[k]
            count[np.searchsorted(gram, u), i] = n
            j = np.searchsorted(context, ctx)
            total[:, i] = np.bincount(j, n, len(context) + 1)
            kinds[:, i] = np.bincount(j[n > 0], minlength=len(context) + 1)
            n1, n2 = float((n == 1).sum()), float((n == 2).sum())
            discount[i] = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        model.levels.append(Level(gram, count, context, total, kinds, discount))
    return model


class Scorer:
    """Sums of word scores; remembers words (bounded: new ones beyond `most` are scored again when they come again)."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, most
        self.at: dict[bytes, int] = {}
        self.row: dict[str, int] = {"": 0}
        self.table = np.zeros((1 << 16, len(model.langs) + 1), np.float32)
        self.used = 1

    def sums(self, texts: list[str]) -> np.ndarray:
        """For each text: log-probability by language, and the number of symbols."""
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if self.used > self.most or len(self.at) > 2 * self.most:
            self.at, self.row, self.used = {}, {"": 0}, 1
        new = set().union(*split).difference(self.at) if split else set()
        word = {c: letters(c) for c in new}
        fresh = list(dict.fromkeys(w for w in word.values() if w not in self.row))
        for a in range(0, len(fresh), 50_000):
            part = fresh[a : a + 50_000]
            logs, n = self.model.log_probs(part)
            while self.used + len(part) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(part), :-1], self.table[self.used : self.used + len(part), -1] = logs, n
            self.row |= {w: self.used + i for i, w in enumerate(part)}
            self.used += len(part)
        for c, w in word.items():
            self.at[c] = self.row[w]
        size = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        out = np.zeros((len(texts), self.table.shape[1]))
        some = size > 0
        if some.any():
            first = (np.cumsum(size) - size)[some]
            for c in range(out.shape[1]):
                out[some, c] = np.add.reduceat(self.table[ids, c].astype(np.float64), first)
        return out


def decided(model: Model, sums: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and rejection of each row of sums."""
    n = sums[:, -1]
    if not model.langs or not len(n):
        return ["und"] * len(n), np.zeros(len(n)), np.full(len(n), np.nan), np.ones(len(n), bool)
    h = -sums[:, :-1] / np.maximum(n, 1)[:, None]
    best = h.argmin(axis=1)
    least = h[np.arange(len(n)), best]
    odds = np.exp(-SHARPNESS * (h - least[:, None]))
    none = n == 0
    limit = model.mean[best] + REJECT_NATS + REJECT_SE * model.sd[best] / np.sqrt(np.maximum(n, 1)) if model.mean is not None else np.full(len(n), np.inf)
    return [("und" if z else model.langs[b]) for z, b in zip(none, best)], np.where(none, 0.0, 1 / odds.sum(axis=1)), np.where(none, np.nan, least), none | (least > limit)


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> Model:
    """A calibrated model from docs(doc_id, text, lang); what reaches the driver is bounded by the sample."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 0))
    many = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return Model([])
    share = F.create_map(*[F.lit(x) for lang, n in sorted(many.items()) for x in (lang, min(1.0, 1.3 * sample_docs / n))])
    key = F.xxhash64("doc_id")
    picked = known.where(F.pmod(key, F.lit(1 << 30)) < share[F.col("lang")] * F.lit(1 << 30))
    picked = picked.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))).where(F.col("_n") <= sample_docs)

    def count(batches):
        # words of training documents; of calibrating ones, each document's words stay together
        held: dict[tuple[str, int], Counter] = {}
        for b in batches:
            for lang, text, f, n in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("_fold").to_pylist(), b.column("_n").to_pylist()):
                held.setdefault((lang, n if f == 1 else 0), Counter()).update(filter(None, map(letters, text.encode("utf-8", "surrogatepass").split())))
        for (lang, n), words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([n] * len(words), pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "doc", "word", "n"])

    rows = picked.withColumn("_fold", fold("doc_id").cast("int")).select("lang", "text", "_fold", "_n").mapInArrow(count, "lang string, doc int, word string, n bigint").groupBy("lang", "doc", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {lang: {} for lang in many}
    tests: dict[tuple[str, int], dict[str, int]] = {}
    for lang, doc, word, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "doc", "word", "n"))):
        (tests.setdefault((lang, doc), {}) if doc else counts[lang])[word] = n
    counts = {k: v for k, v in counts.items() if v}
    model = train(counts, order)
    scorer = Scorer(model)
    mean, sd = np.zeros(len(model.langs)), np.zeros(len(model.langs))
    for i, lang in enumerate(model.langs):
        h, size = [], []
        for (of, _), words in sorted(tests.items()):
            if of == lang:
                logs, n = model.log_probs(list(words))
                times = np.array(list(words.values()))
                size.append(float((n * times).sum()))
                h.append(float(-(logs[:, i] * times).sum()) / size[-1])
        if h:
            h, size = np.array(h), np.array(size)
            mean[i] = np.median(h)
            sd[i] = np.sqrt(np.median((h - mean[i]) ** 2 * size)) * 1.4826
        else:
            mean[i], sd[i] = np.inf, 0
    del scorer
    model.mean, model.sd = mean, sd
    return model


def languages(docs: DataFrame, learn_from: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(docs if learn_from is None else learn_from, sample_docs, order))  # bounded by the sample
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        lean()
        scorer = scorer_of(sent.value)
        for b in bites(batches):
            texts = texts_of(b.column("text"))
            lang, score, h, out = decided(sent.value, scores(scorer, texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64(), from_pandas=True), pa.array(out, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(fold("doc_id") == 0, F.lit(True)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def scorer_of(model: Model) -> Scorer:
    """One memory of words for each Python worker and model."""
    return memory(f"words {id(model)}", lambda: Scorer(model))


def scores(scorer: Scorer, texts: list[str], chars: int = 4_000_000) -> np.ndarray:
    parts, part, held = [np.zeros((0, scorer.table.shape[1]))], [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= chars:
            parts.append(scorer.sums(part))
            part, held = [], 0
    if part:
        parts.append(scorer.sums(part))
    return np.concatenate(parts)


def accepted(docs: DataFrame, learn_from: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> DataFrame:
    """The rows of docs that language identification doesn't reject, with all their columns as they are."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(docs if learn_from is None else learn_from, sample_docs, order))

    def run(batches):
        lean()
        scorer = scorer_of(sent.value)
        for b in bites(batches):
            keep = ~decided(sent.value, scores(scorer, texts_of(b.column("text"))))[3]
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
