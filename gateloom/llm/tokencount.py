"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced together.

A boundary p between two characters is proven stable for a byte-level BPE whose splitting pattern never lets a
piece run from a visible character into white space: where text[p - 1] is visible and text[p] is white space, a piece ends
at p whatever stands further left or right. Chunks are spliced at such a p that both encodings also show as the
start of a token. If the overlap holds none, the overlap is widened, in the end to the whole text.

Texts that aren't huge are cut at such boundaries too, into a visible stretch and the white space before it; the
library encodes each distinct stretch once, and its count is remembered (a bounded number of them).

Cases: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows each get their row; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.llm.common import bites, memory, texts_of

#: Characters of a chunk, of the first overlap, and of texts that are encoded whole.
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 256
#: White space to every splitting pattern; str.isspace() takes in more than any pattern does.
SPACE = " \t\n\r\x0b\x0c"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def load(path: str):
    """The tokenizer of a .json file (tokenizers) or of a .model file (sentencepiece)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def long_ids(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Token ids of a text of any length, the same as of the whole text at once."""
    encode = lambda a, b: tok.encode(text[a:b], add_special_tokens=False)
    n, ids = len(text), []
    base, end = 0, min(len(text), chunk)  # of the chunk at hand
    done = 0  # ids up to this character are in ids
    enc = encode(base, end)
    while end < n:
        width, joint = overlap, None
        while joint is None:
            start = end - width
            if start <= done:  # the overlap has grown to all that is left of the chunk: lengthen the chunk instead
                end = min(n, end + max(chunk, end - done))
                base, width = done, overlap
                enc = encode(base, end)
                if end == n:
                    break
                continue
            stop = min(n, start + chunk + width)
            nxt = encode(start, stop)
            mine = {base + a for a, _ in enc.offsets}
            joint = next((start + a for a, _ in nxt.offsets if a > 0 and start + a < end and start + a > done and start + a in mine and text[start + a] in SPACE and not text[start + a - 1].isspace()), None)
            if joint is None:
                width *= 2
        if joint is None:
            break
        ids += [i for i, (a, _) in zip(enc.ids, enc.offsets) if done <= base + a < joint]
        done, base, end, enc = joint, start, stop, nxt
    ids += [i for i, (a, _) in zip(enc.ids, enc.offsets) if base + a >= done]
    return ids


class Stretches(dict):
    """Token counts of stretches (ASCII white space, then visible characters); new ones beyond `most` aren't kept."""

    PATTERN = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$")
    #: Letters, then signs: every splitting pattern ends a piece between the two.
    STEM = re.compile(r"([ \t\n\r\x0b\x0c]*[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
    #: White space to some pattern or to Python, but not ASCII's: next to it nothing is proven.
    OTHER = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")

    def __init__(self, tok, most: int = 900_000):
        super().__init__()
        self.tok, self.most, self.passing = tok, most, {}

    def __missing__(self, x: str) -> int:
        return self.passing[x]

    def counts(self, texts: list[str]) -> list[int]:
        split = [[t] if not t.isascii() and self.OTHER.search(t) else self.PATTERN.findall(t) for t in texts]
        found = {x for x in set().union(*split) if x not in self}
        match = self.STEM.fullmatch
        parts = {x: m.groups() for x in found if (m := match(x))}
        new = [y for y in {y for pair in parts.values() for y in pair}.union(found.difference(parts)) if y not in self]
        self.passing = {}
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            into = self if len(self) + len(part) <= self.most else self.passing
            for x, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (into if len(x) < 100 else self.passing)[x] = len(e)
        into = self if len(self) + len(parts) <= self.most else self.passing
        for x, (stem, signs) in parts.items():
            into[x] = self[stem] + self[signs]
        return [sum(map(self.__getitem__, x)) for x in split]


def counts(tok, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    if not hasattr(tok, "encode_batch_fast"):
        return [len(x) for x in tok.encode(list(texts), num_threads=1)] if texts else []
    out = [0] * len(texts)
    whole = [i for i, t in enumerate(texts) if len(t) <= chunk]
    known = memory(f"stretches {id(tok)}", lambda: Stretches(tok))
    for a in range(0, len(whole), 512):
        part = whole[a : a + 512]
        for i, n in zip(part, known.counts([texts[i] for i in part]), strict=True):
            out[i] = n
    for i, t in enumerate(texts):
        if len(t) > chunk:
            out[i] = len(long_ids(tok, t, chunk, overlap))
    return out


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tok = load(tokenizer_path(vocabulary))
        for b in bites(batches):
            texts = texts_of(b.column("text"))
            n = counts(tok, texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
