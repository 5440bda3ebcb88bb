"""Secrets in texts: three fixed patterns, and values next to a credential word that would be costly to guess.

The guess cost of a value is that of its cheapest segmentation (dynamic programming over its characters) into
known words, dates, repeats, keyboard walks and spans that only brute force covers; costs multiply along a
segmentation and each further segment costs a factor, so their logarithms add up. Words are a list of common ones and the
most frequent ones of the corpus itself, each at the cost of its rank. Every value in a credential context is priced, those
that a fixed pattern has too: one whose cost reaches 10^MIN_LOG10 guesses is a secret; a cheaper one (a placeholder, an
example, a plain word) is not, and a reference to a variable isn't a value.

Cases: a null text counts as empty; no span gives the empty string (and its SHA-256); a null doc_id is kept; repeated
rows each get their row; an empty table gives an empty table; other columns are ignored, or kept by redacted().
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.llm.common import bites, texts_of

#: A credential value is a secret from so many guesses on (as log10).
MIN_LOG10 = 9.0
#: The most frequent words of a corpus that are known; characters of a word; ends of a walk that are tried besides its own.
RANKED, LETTERS, WALK = 50_000, (3, 24), 64

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The context of a credential: a word for it, perhaps as a part of a name, then a sign and the value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)[\w-]{0,32}["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*["']?([^\s"'<>,;]{6,})""", re.A | re.I)
HINTS = (b"passw", b"passphrase", b"passcode", b"pwd", b"secret", b"token", b"credential", b"key")
KINDS = ("assign", "access", "hex", "guess")
#: Common passwords and words in them or in settings, from the most common on; a word's rank is its number of guesses.
WORDS = """password secret admin welcome letmein monkey dragon master login princess sunshine football shadow qwerty
hello freedom whatever trustno baseball superman batman access flower summer winter spring autumn hunter
test testing example sample changeme default user username root guest demo temp token key value your my the
none null true false string text here insert placeholder redacted hidden data server client service dev prod
staging local host company account private public auth api word pass code phrase love baby angel
config configuration setting environ environment env variable system database session cookie bearer basic
international national general company office home house family elephant tiger lion eagle horse computer internet
network security manager required optional enter please change replace dummy foo bar baz todo unknown undefined
name number email phone address file path url http https www com org net get set not for and with from this that
ing tion ation ment able ness inter over under re un pre ly er ed es""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(a, b) for r in ROWS for a, b in (*zip(r, r[1:]), *zip(r[1:], r))} | {(a, b) for a, b in zip("abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyz")}
LEET = str.maketrans("4@301!$57", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)?\d\d)")


def alphabet(s: str) -> int:
    return max(10, sum(n for n, has in ((10, any(c.isdigit() for c in s)), (26, any(c.islower() for c in s)), (26, any(c.isupper() for c in s)), (33, any(not c.isalnum() for c in s))) if has))


#: A value that names a variable or stands in for one.
REFERENCE = re.compile(r"[$%]?\{{1,2}[^{}]*\}{1,2}|\$(?-i:[A-Z_][A-Z0-9_]*)|%\(\w+\)s|%\w+%|<[^<>]*>?|(?:os\.environ|process\.env|getenv|env|secrets|vars?|self|config|settings)(?:[.\[(].*)?", re.I)


class Guesser:
    """Guess costs by a dictionary of words: RANK and those of a corpus."""

    def __init__(self, extra: dict[str, int]):
        self.rank = {w: r for w, r in extra.items() if LETTERS[0] <= len(w) <= LETTERS[1]} | {w: r for w, r in RANK.items() if len(w) >= LETTERS[0]}
        self.longest = max(map(len, self.rank))

    def pieces(self, s: str):
        """(start, end, log10 of guesses) of the words, dates, repeats and walks in s."""
        n, low = len(s), s.lower()
        if len(low) != n:  # a few letters have a longer lower case
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in s)
        plain = low.translate(LEET)
        brute = math.log10(alphabet(s))
        again = {w: self.runs(n, lambda i, w=w: i + w < n and s[i] == s[i + w]) for w in range(1, 9)}
        walk = self.runs(n, lambda i: i + 1 < n and (low[i], low[i + 1]) in NEXT)
        for a in range(n):
            for b in range(a + LETTERS[0], min(n, a + self.longest) + 1):
                case = s[a:b]
                for word, more in ((low[a:b], 0.0), (plain[a:b], 0.7)):
                    if word in self.rank:
                        yield a, b, math.log10(self.rank[word] + 1) + more + (0 if case.islower() else 0.3 if case[0].isupper() and case[1:] == case[1:].lower() else 0.3 * len(case) ** 0.5)
            if m := DATE.match(s, a):
                yield a, m.end(), math.log10(365 * 120) if m.end() - a > 4 else math.log10(120)
            for w, run in again.items():  # as many repeats of a unit as there are
                k = run[a] // w + 1
                if k > 1 and k * w >= 3:
                    yield a, a + k * w, w * brute + math.log10(k)
            end = a + walk[a] + 1
            for b in {*range(a + 3, min(end, a + WALK) + 1), *([end] if end >= a + 3 else [])}:  # walks over the keyboard or the alphabet
                yield a, b, math.log10(47 * 4 * (b - a))

    @staticmethod
    def runs(n: int, holds) -> list[int]:
        """For each place how many places from it on hold, without a gap."""
        out = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            out[i] = out[i + 1] + 1 if holds(i) else 0
        return out

    def cost(self, value: str) -> float:
        """log10 of the guesses that the cheapest segmentation of a value takes, in time that grows with its length."""
        if REFERENCE.fullmatch(value):
            return 0.0
        brute = math.log10(alphabet(value))
        best = [0.0] + [math.inf] * len(value)
        at = 0
        for a, b, c in self.pieces(value):
            for at in range(at, a):
                best[at + 1] = min(best[at + 1], best[at] + brute)  # one more character by brute force
            at = a
            best[b] = min(best[b], best[a] + 0.3 * (a > 0) + c)  # each further segment: the guesser must find where it begins
        for i in range(at, len(value)):
            best[i + 1] = min(best[i + 1], best[i] + brute)
        return best[-1]


def word_ranks(docs: DataFrame) -> dict[str, int]:
    """The RANKED most frequent words of letters only, by counts over all texts, after WORDS; so many rows at most reach the driver."""

    def count(batches):
        held: Counter[str] = Counter()

        def given():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

        for b in bites(batches):
            part: Counter[str] = Counter()
            for t in texts_of(b.column("text")):
                part.update(t.lower().split())
            for w, n in part.items():
                w = w.strip(".,;:!?()'\"")
                if LETTERS[0] <= len(w) <= LETTERS[1] and w.isalpha():
                    held[w] += n
            if len(held) > 400_000:
                yield given()
                held.clear()
        yield given()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return {r["w"]: len(WORDS) + i for i, r in enumerate(rows.orderBy(F.desc("n"), "w").limit(RANKED).collect(), 1)}


def guess_cost(value: str, extra: dict[str, int] | None = None) -> float:
    return Guesser(extra or {}).cost(value)


def base_spans(text: str, low: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three fixed patterns, by start and then kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower() if low is None else low
    if any(x in low for x in HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in low:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def guessed_spans(text: str, low: bytes, guess: Guesser, least: float = MIN_LOG10) -> list[tuple[int, int, int]]:
    """(start, end, 3) of credential values that cost 10^least guesses or more."""
    if not any(x in low for x in HINTS):
        return []
    return [(*m.span(1), 3) for m in CONTEXT.finditer(text) if guess.cost(m[1]) >= least]


def spans_of(text: str, guess: Guesser, least: float = MIN_LOG10) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, of a text."""
    low = text.encode("utf-8", "surrogatepass").lower()
    base = base_spans(text, low)
    return base, sorted([*base, *guessed_spans(text, low, guess, least)], key=lambda x: (x[0], x[2]))


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, least: float = MIN_LOG10) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess for each row of docs(doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    told = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))

    def run(batches):
        guess = Guesser(told.value)
        for b in bites(batches):
            rows = [spans_of(t, guess, least) for t in texts_of(b.column("text"))]
            count = lambda k: pa.array([sum(x[2] == k for x in all_) for _, all_ in rows], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), count(0), count(1), count(2), pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([shown(x) for _, x in rows], pa.string()), count(3)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint")


def cut_out(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by mark."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, least: float = MIN_LOG10, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark, all columns kept; n_chars, if there, follows the new text. A null text stays null."""
    told = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))

    def run(batches):
        guess = Guesser(told.value)
        for b in bites(batches):
            names = b.schema.names
            texts = b.column("text").to_pylist()
            new = [None if t is None else cut_out(t, spans_of(t, guess, least)[1], mark) for t in texts]
            cols = dict(zip(names, b.columns, strict=True))
            cols["text"] = pa.array(new, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([x if t == s else len(s) for x, t, s in zip(cols["n_chars"].to_pylist(), texts, new, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)
