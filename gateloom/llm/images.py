"""Copies of images, cropped or edited too, by local descriptors.

Each image (binary PGM, or rows of bytes that raster() makes of a text) gives corners at two scales (Harris response, the greatest in
their surroundings; all above a fixed response are kept), each with an orientation (direction of the intensity
centroid) and 64 binary tests of a smoothed patch turned by it. Equal images are one picture.

A corner weighs the more the fewer pictures hold it: page furniture that all share says little, yet an image of nothing else
still has all its own weight in it. Descriptors meet in Hamming tables: two halves of 32 bits, of which one is equal wherever two
descriptors differ in one bit at most. An image asks with its weightiest corners, ASKED of its weight; SHARE of it must agree for a
link (corners at the edge that a cut may have changed count only if they match), so part of what it asks with meets. Two corners that meet must also stand in like surroundings, told by a majority of
hashes of the corners around them. Pairs that met are compared, corner by corner: matches vote for the turn,
scale and shift between the two images, bins of LEAST_BIN or more count, so that several pieces that moved apart (an insertion) add
up, and a pair is linked if SHARE of the weight agrees. Links become classes.

Pictures fall into blocks by a hash of the id. A task compares a block with itself; then one for each two blocks compares what links haven't
connected. Each picture is compared with few others first, then with all that meet it in no class with it yet. Pairs never leave a task, and a key
that many hold is spread over all; the comparisons of pictures that meet and stay apart are the square of their number all the same.

Cases: a null, empty or undecodable image has no corner, no link and a class of its own; null ids get no link; repeated
ids count as one image; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.llm.common import bites, dealt, gathered, join_small, lean, mixed, shards, slots, stored
from gateloom.llm.simhash import components

#: Width of a text's raster; radius of a patch; steps of the orientation; least response; edge of a voting bin.
WIDTH, PATCH, TURNS, RESPONSE, BIN = 64, 7, 16, 2.0e6, 6
#: Votes that a bin needs to count; corners that a link needs, and their share of the weight of the image with fewer; differing bits.
LEAST_BIN, LEAST, SHARE, BITS = 3, 8, 0.6, 4
#: Share of its weight that an image asks with; differing bits of surroundings, which are so many rows to both sides.
ASKED, FAR, AROUND = 0.5, 20, 32
#: Keys that reach the driver at most; entries of a key in a task beyond which each first meets few; corners of a block that are in arrays at a time.
COMMON, SPLIT, HELD = 500_000, 64, 1_500_000
#: Bits that tell keys of several pictures, and of them in a piece.
SEVERAL, PAGE = 1 << 26, 1 << 20
#: Pixels that are handled at a time: few enough to stay in a core's cache.
PIXELS = 250_000
#: Bytes of arrays that aren't kept for reuse.
LARGE = 1 << 24
#: Pictures that move in a pass, as a multiple of all pictures.
ROOM = 1.5
#: Corners this near in rows and columns compete.
NEAR = 9


def raster(text: str, width: int = WIDTH) -> bytes:
    """A text as a PGM image: a byte is a pixel, and each piece up to > or a line break starts a new row."""
    data = text.encode("utf-8", "surrogatepass").replace(b"\n", b">")
    rows = b"".join(x.ljust(-(-len(x) // width) * width, b"\0") for x in data.split(b">") if x)
    return b"P5 %d %d 255\n" % (width, len(rows) // width) + rows


def decoded(image: bytes | None) -> np.ndarray:
    """The pixels of a binary PGM of 8 bits; none if it isn't one."""
    none = np.zeros((0, 0), np.uint8)
    if not image or image[:2] != b"P5":
        return none
    head = image[:64].split(None, 4)
    try:
        w, h, top = int(head[1]), int(head[2]), int(head[3])
        start = image.index(head[3], image.index(head[2], image.index(head[1], 2) + len(head[1])) + len(head[2])) + len(head[3]) + 1
        return np.frombuffer(image, np.uint8, w * h, start).reshape(h, w) if top < 256 else none
    except (ValueError, IndexError):
        return none


def tests(turns: int = TURNS, seed: int = 7) -> np.ndarray:
    """(turn, test, point, (row, column)): 64 pairs of points within the patch, turned by each step."""
    at = np.random.default_rng(seed).normal(0, PATCH / 2.2, (64, 2, 2)).clip(-PATCH + 2, PATCH - 2)
    angle = np.arange(turns) * 2 * np.pi / turns
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    y, x = at[None, :, :, 0], at[None, :, :, 1]
    return np.rint(np.stack([c * y + s * x, c * x - s * y], axis=3)).astype(np.int64)


TESTS = tests()
DISC = np.array([(y, x) for y in range(-4, 5) for x in range(-4, 5) if y * y + x * x <= 16])


def box(a: np.ndarray) -> np.ndarray:
    """Sums over 3 x 3 pixels."""
    b = a.copy()
    b[1:] += a[:-1]
    b[:-1] += a[1:]
    c = b.copy()
    c[:, 1:] += b[:, :-1]
    c[:, :-1] += b[:, 1:]
    return c


def greatest(a: np.ndarray, width: int = NEAR) -> np.ndarray:
    """The greatest value among width x width pixels around each."""
    r = width // 2
    m = np.full((a.shape[0] + 2 * r, a.shape[1] + 2 * r), -np.inf, a.dtype)
    m[r : a.shape[0] + r, r : a.shape[1] + r] = a
    for axis in (0, 1):
        have = 1
        while have < width:
            step = min(have, width - have)
            m = np.maximum(m[:-step], m[step:]) if axis == 0 else np.maximum(m[:, :-step], m[:, step:])
            have += step
    return m


def halved(a: np.ndarray) -> np.ndarray:
    """The means of 2 x 2 pixels; an odd row or column is left out."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    rows = a[0:h:2].astype(np.float32) + a[1:h:2]
    return (rows[:, 0:w:2] + rows[:, 1:w:2]) / np.float32(4)


def described(images: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """image (place in the list), y, x, scale, turn, descriptor of every corner; the images are handled as one tall picture."""
    gap = PATCH + 2
    width = max((i.shape[1] for i in images), default=0) + 2 * gap
    out = []
    for scale in (0, 1):
        own = images if not scale else [halved(i) for i in images]
        height = [len(i) for i in own]
        top = np.cumsum([gap, *(h + gap for h in height)])
        tall = np.zeros((int(top[-1]), width), np.float32)
        for i, y in zip(own, top):
            if i.size:
                tall[y : y + i.shape[0], gap : gap + i.shape[1]] = i
        smooth = box(tall)
        gy, gx = np.zeros_like(tall), np.zeros_like(tall)
        gy[1:-1] = smooth[2:] - smooth[:-2]
        gx[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
        gy /= 9
        gx /= 9
        a, b, c = box(gy * gy), box(gx * gx), box(gx * gy)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        y, x = np.nonzero((r >= RESPONSE) & (r == greatest(r)))
        image = np.searchsorted(top, y, "right") - 1
        inside = (y - top[image] < np.array([*height, 0])[image]) & (x >= gap) & (x < width - gap)
        y, x, image = y[inside], x[inside], image[inside]
        flat, at = smooth.reshape(-1), y * width + x
        turn, d = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
        disc, (one, two) = DISC[:, 0] * width + DISC[:, 1], np.moveaxis(TESTS[..., 0] * width + TESTS[..., 1], 2, 0)
        for i in range(0, len(at), 2_000):
            p = at[i : i + 2_000, None]
            moment = (flat.take(p + disc) @ DISC.astype(np.float32)).astype(np.float64)
            t = np.rint(np.arctan2(moment[:, 0], moment[:, 1]) * (TURNS / 2 / np.pi)).astype(np.int64) % TURNS
            turn[i : i + 2_000] = t
            # the gap is wider than a patch: no place is outside
            d[i : i + 2_000] = np.packbits(flat.take(p + one[t]) < flat.take(p + two[t]), axis=1, bitorder="little").view(np.uint64).reshape(-1)
        out.append((image, y - top[image], x - gap, np.full(len(at), scale), turn, d))
    return tuple(np.concatenate(c) for c in zip(*out))


#: A corner as it is stored and compared: its descriptor, place, scale and turn.
CORNER = np.dtype([("d", "<u8"), ("y", "<i4"), ("x", "<i4"), ("scale", "u1"), ("turn", "u1")])


def corners(images: DataFrame) -> DataFrame:
    """id, pixels (a digest of shape and pixels; null without pixels), n, data (n records of CORNER) of images(id bigint, image binary)."""

    def run(batches):
        lean(LARGE)
        for b in bites(batches):
            ids, data = b.column("id").to_pylist(), b.column("image").to_pylist()
            part, held, at = [], 0, 0
            for i, raw in enumerate(data):
                part.append(decoded(raw))
                held += part[-1].size
                if held >= PIXELS or i == len(data) - 1:
                    image, y, x, scale, turn, d = described(part)
                    order = np.argsort(image, kind="stable")
                    rows = np.zeros(len(order), CORNER)
                    for name, v in zip(CORNER.names, (d, y, x, scale, turn)):
                        rows[name] = v[order]
                    n = np.bincount(image, minlength=len(part))
                    packed = [r.tobytes() for r in np.split(rows, np.cumsum(n)[:-1])]
                    pixels = [xxhash.xxh3_128_digest(b"%d %d " % p.shape + p.tobytes()) if p.size else None for p in part]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(part)], pa.int64()), pa.array(pixels, pa.binary()), pa.array(n.astype(np.int32)), pa.array(packed, pa.binary())], names=["id", "pixels", "n", "data"])
                    at, part, held = i + 1, [], 0

    return images.select("id", "image").mapInArrow(run, "id bigint, pixels binary, n int, data binary")


def keys(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of descriptors in the two tables: a half and the number of the table."""
    return (d & np.uint64(0xFFFFFFFF)).view(np.int64), (d >> np.uint64(32) | np.uint64(1 << 32)).view(np.int64)


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def grown(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def hashed(key: np.ndarray) -> np.ndarray:
    """The bit that stands for a key in a bitmap of SEVERAL bits."""
    return mixed(key.view(np.uint64)) % np.uint64(SEVERAL)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1 == 1


def paged(h: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The numbers and bits of the pieces of a bitmap in which the bits h are set."""
    h = np.unique(h)
    page, first = np.unique(h // np.uint64(PAGE), return_index=True)
    out = []
    for part in np.split(h % np.uint64(PAGE), first[1:]) if len(h) else ():
        bits = np.zeros(PAGE, bool)
        bits[part.astype(np.int64)] = True
        out.append(squeeze(np.packbits(bits, bitorder="little")))
    return pa.array(page.astype(np.int64)), pa.array(out, pa.binary())


def bitmap(pages: DataFrame) -> np.ndarray:
    """The union of pages(key bigint, bits binary), made by paged(): SEVERAL bits at most reach the driver, a row for each piece."""

    def merged(batches):
        pages: dict[int, np.ndarray] = {}
        for b in batches:
            for p, data in zip(b.column("key").to_pylist(), b.column("bits").to_pylist()):
                bits = grown(data)
                pages[p] = bits if p not in pages else pages[p] | bits
        if pages:
            yield pa.RecordBatch.from_arrays([pa.array(list(pages)), pa.array([squeeze(x) for x in pages.values()], pa.binary())], names=["key", "bits"])

    out = np.zeros(SEVERAL // 8, np.uint8)
    for r in pages.select("key", "bits").repartition(shards(pages.sparkSession), "key").mapInArrow(merged, "key bigint, bits binary").collect():
        out[r["key"] * PAGE // 8 : (r["key"] + 1) * PAGE // 8] = grown(r["bits"])
    return out


class Weights:
    """How much a corner tells: log2(1 + pictures / pictures with its rarer half).

    Halves of fewer than `least` pictures count as `least`, and few pictures as 1,000: what two of ten hold isn't common yet.
    """

    def __init__(self, key: np.ndarray, often: np.ndarray, least: int, pictures: int):
        self.key, self.often, self.least, self.pictures = key, often, least, max(1_000, pictures)
        self.asked = np.ones(len(key), bool)
        #: One bit for each of SEVERAL hash values of keys, set if two pictures or more hold a key with it.
        self.several = np.full(SEVERAL // 8, 255, np.uint8)

    def __getstate__(self):
        # a broadcast is a file on the driver and on each executor
        return self.__dict__ | {"several": squeeze(self.several)}

    def __setstate__(self, state):
        self.__dict__.update(state | {"several": grown(state["several"])})

    def known(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key is among the counted ones, and where."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, at

    def useful(self, key: np.ndarray) -> np.ndarray:
        """False for keys that can't make two pictures meet: known to be asked by nobody, or held by one picture."""
        known, at = self.known(key)
        out = has(self.several, hashed(key))
        return out & (~known | self.asked[at]) if len(self.asked) else out

    def held(self, key: np.ndarray) -> np.ndarray:
        """How many pictures hold a key, `least` or more."""
        known, at = self.known(key)
        return np.where(known, np.maximum(self.often[at], self.least), self.least) if len(self.key) else np.full(len(key), self.least)

    def of(self, d: np.ndarray) -> np.ndarray:
        low, high = keys(d)
        return np.log2(1 + self.pictures / np.minimum(self.held(low), self.held(high)))

    def asking(self, d: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The share of its image's weight for each corner that asks, else 0. d: the corners of images of n corners each."""
        of, w = np.repeat(np.arange(len(n)), n), self.of(d)
        whole = np.bincount(of, w, minlength=len(n))
        order = np.lexsort((mixed(d), -w, of))
        sums = np.cumsum(w[order]) - w[order]
        before = np.empty(len(d))
        before[order] = sums - np.repeat(sums[np.minimum(np.cumsum(n) - n, len(d) - 1)], n)
        return np.where(before <= ASKED * whole[of], w / whole[of], 0).astype(np.float32)


def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, numbers of corners and all corners of a batch of pictures that have some."""
    ids, n = b.column("id").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    return ids[n > 0], n[n > 0], np.concatenate([np.zeros(0, CORNER), *(np.frombuffer(x, CORNER) for x in b.column("data").to_pylist())])


def weights(pictures: DataFrame) -> Weights:
    """Counts the pictures of each key. Of all keys at most COMMON reach the driver: their least count follows from the number of corners."""
    n = shards(pictures.sparkSession)
    names = slots(n)
    size = pictures.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("c")).first()
    least = max(1, -(-2 * size["c"] // COMMON))

    def spread(batches):
        for b in bites(batches, 4096):
            key = np.concatenate([np.zeros(0, np.int64), *(np.unique(k) for x in b.column("data").to_pylist() for k in keys(np.frombuffer(x, CORNER)["d"]))])
            key, often = np.unique(key, return_counts=True)
            yield dealt((mixed(key) % np.uint64(n)).astype(np.int64), {"key": key, "n": often.astype(np.int32)}, names)

    def count(batches):
        got = gathered(batches, {"key": np.int64, "n": np.int32})
        key, inv = np.unique(got["key"], return_inverse=True)
        often = np.zeros(len(key), np.int64)
        np.add.at(often, inv, got["n"])
        some = (often >= least) & (often > 1)
        page, bits = paged(hashed(key[often > 1]))
        yield pa.RecordBatch.from_arrays([page, pa.array(np.zeros(len(page), np.int64)), bits], names=["key", "n", "bits"])
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(often[some]), pa.nulls(int(some.sum()), pa.binary())], names=["key", "n", "bits"])

    found = stored(pictures.select("data").mapInArrow(spread, "part int, data binary").repartition(n, "part").mapInArrow(count, "key bigint, n bigint, bits binary"), "keys")
    rows = found.where("bits IS NULL").select("key", "n").toArrow()
    key, often = (rows.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(key)
    out = Weights(key[order], often[order], least, size["n"])
    out.several = bitmap(found.where("bits IS NOT NULL"))
    told = pictures.sparkSession.sparkContext.broadcast(out)

    def asked(batches):
        for b in bites(batches, 4096):
            _, n, r = flat(b)
            if len(n):
                some = told.value.asking(r["d"], n) > 0
                for k in keys(r["d"][some]):
                    known, at = told.value.known(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(at[known]))], names=["at"])

    out.asked[:] = False
    out.asked[pictures.select("id", "n", "data").mapInArrow(asked, "at bigint").distinct().toArrow().column("at").to_numpy()] = True
    return out


def surroundings(of: np.ndarray, r: np.ndarray) -> np.ndarray:
    """64 bits for each corner: the majority of hashes of the halves of all corners of its image and scale within AROUND rows."""
    y = (of.astype(np.int64) * 2 + r["scale"]) * (1 << 22) + r["y"]
    order = np.argsort(y, kind="stable")
    y, d = y[order], r["d"][order]
    low, high = (mixed(k.view(np.uint64)) for k in keys(d))
    a, b = np.searchsorted(y, y - AROUND, "left"), np.searchsorted(y, y + AROUND, "right")
    # some bits at a time are counted in lanes of one number, which are wide enough for the two halves of all that stand around
    most = int((b - a).max(initial=0))
    lane = 8 if most < 1 << 7 else 16 if most < 1 << 15 else 32
    ones = np.uint64(sum(1 << i for i in range(0, 64, lane)))
    more = (np.uint64((1 << lane - 1) - 1) - (b - a).astype(np.uint64)) * ones
    sums, out = np.zeros(len(d) + 1, np.uint64), np.zeros(len(d), np.uint64)
    for bit in np.arange(lane, dtype=np.uint64):
        np.cumsum((low >> bit & ones) + (high >> bit & ones), out=sums[1:])
        out |= (sums[b] - sums[a] + more >> np.uint64(lane - 1) & ones) << bit
    back = np.empty_like(out)
    back[order] = out
    return back


def agreeing(n) -> np.ndarray:
    """Corners that must agree for a link to an image of n corners."""
    return np.clip(n, LEAST_BIN, LEAST)


def at_edge(r: np.ndarray, of: np.ndarray | int = 0) -> np.ndarray:
    """Corners so near the edge of what an image's corners span that a cut there would have changed their patch; in columns only beyond WIDTH. of: the number of each corner's image."""
    group = of * 2 + r["scale"].astype(np.int64)
    order = np.argsort(group, kind="stable")
    new = np.r_[True, group[order][1:] != group[order][:-1]][: len(r)]
    first, at, out = np.nonzero(new)[0], np.cumsum(new) - 1, np.zeros(len(r), bool)
    for axis, least in (("y", 0), ("x", WIDTH)) if len(r) else ():
        v = r[axis][order]
        low, high = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
        wide = high - low > least >> r["scale"][order[first]].astype(np.int64)
        out[order] |= wide[at] & ((v < low[at] + PATCH) | (v > high[at] - PATCH))
    return out


def bins(a: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Numbers of the voting bins (turn, scale and shift) of corners a that match corners own."""
    turn = (own["turn"].astype(np.int64) - a["turn"]) % TURNS
    s, ls = own["scale"].astype(np.int64), a["scale"].astype(np.int64)
    c, sn, grown = np.cos(turn * 2 * np.pi / TURNS), np.sin(turn * 2 * np.pi / TURNS), 2.0 ** (s - ls)
    x, y, lx, ly = own["x"] * 2.0**s, own["y"] * 2.0**s, a["x"] * 2.0**ls, a["y"] * 2.0**ls
    tx, ty = np.rint((x - grown * (c * lx - sn * ly)) / BIN).astype(np.int64), np.rint((y - grown * (sn * lx + c * ly)) / BIN).astype(np.int64)
    return ((ty & 0xFFFFFFFF) << 24) | ((tx & 0xFFFF) << 8) | (turn << 2) | (s - ls + 1)


def score(a: np.ndarray, b: np.ndarray, weight: np.ndarray, edge: np.ndarray | None = None) -> tuple[int, float]:
    """How many corners of b (fewer than a's, or as many) agree with corners of a, and their share of b's weight: bins of LEAST_BIN or more count.

    Corners at_edge() (edge, if known) that match nothing are left out of that weight.
    """
    near = np.bitwise_count(a["d"][:, None] ^ b["d"]) <= BITS
    some = near.any(axis=0)
    whole = max(1e-300, weight[some | ~(at_edge(b) if edge is None else edge)].sum())
    if weight[some].sum() < SHARE * whole:
        return 0, 0.0
    p, q = np.nonzero(near)
    where = bins(a[p], b[q])
    # a corner of b votes once in a bin, and counts once however many bins it is in
    vote = np.unique(np.stack([where, q]), axis=1)
    _, at, n = np.unique(vote[0], return_inverse=True, return_counts=True)
    agree = np.unique(vote[1][n[at] >= LEAST_BIN])
    return len(agree), float(weight[agree].sum() / whole)


def hopeful(many: list[np.ndarray], d: np.ndarray, weight: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Which of many images (their descriptors) have enough corners like those of one to reach SHARE in score(); none that does is left out."""
    out, sizes = [], np.array([len(x) for x in many])
    ends = np.cumsum(sizes)
    k = 0
    while k < len(many):
        e = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 1_000_000 // max(1, len(d)), "right")))
        near = np.bitwise_count(np.concatenate(many[k:e])[:, None] ^ d) <= BITS
        some = np.logical_or.reduceat(near, np.cumsum(sizes[k:e]) - sizes[k:e], axis=0)
        out.append(some @ weight >= (SHARE - 1e-6) * ((some | ~edge) @ weight))
        k = e
    return np.concatenate(out)


class Cells:
    """Where pairs are compared: a hash of a gives the pass and the column, one of b the row; a cell is one task of its pass.

    So a picture moves to a row or a column of cells at most, and in a pass not much more moves than room (pictures),
    which keeps the disk in proportion to the input however many pairs there are.
    """

    def __init__(self, n: int, pairs: int, bs: int, As: int, room: int):
        self.passes = 1
        while True:
            self.rows = min(n, max(1, round((n * bs * self.passes / max(1, As)) ** 0.5)))
            self.columns = n // self.rows
            if min(2 * pairs / self.passes, self.columns * bs + self.rows * As / self.passes) <= room or self.passes >= max(1, As):
                break
            self.passes += 1 + self.passes // 8
        self.names = slots(n)

    def row(self, b: np.ndarray) -> np.ndarray:
        return (mixed(b.view(np.uint64)) % np.uint64(self.rows)).astype(np.int64)

    def column(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pass and the column."""
        h = (mixed(a.view(np.uint64)) >> np.uint64(32)) % np.uint64(self.columns * self.passes)
        return (h // np.uint64(self.columns)).astype(np.int64), (h % np.uint64(self.columns)).astype(np.int64)

    def dealt(self, pairs: DataFrame, turn: int) -> DataFrame:
        """block, b, a of the pairs of a pass."""

        def run(batches):
            for r in batches:
                b, a = r.column("b").to_numpy(), r.column("a").to_numpy()
                at, column = self.column(a)
                own = at == turn
                yield pa.RecordBatch.from_arrays([pa.array(self.names[self.row(b[own]) * self.columns + column[own]]), pa.array(b[own]), pa.array(a[own])], names=["block", "b", "a"])

        return pairs.select("b", "a").mapInArrow(run, "block int, b bigint, a bigint")

    def homes(self, ids: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """place in ids, block: the cells of a pass that may ask for a picture, as b or as a."""
        at, column = self.column(ids)
        own = np.nonzero(at == turn)[0]
        as_b = self.row(ids)[:, None] * self.columns + np.arange(self.columns)
        as_a = np.arange(self.rows) * self.columns + column[own, None]
        row = np.r_[np.repeat(np.arange(len(ids)), self.columns), np.repeat(own, self.rows)]
        both = np.unique(row * len(self.names) + np.r_[as_b.reshape(-1), as_a.reshape(-1)])
        return both // len(self.names), self.names[both % len(self.names)]


def moved(pairs: DataFrame, pictures: DataFrame, homes=None) -> DataFrame:
    """block, id, other, data: the pairs (block, b, a) as b and other, and the corners of each of a block's pictures once, not once a pair.

    homes: gives place and block of those blocks that may need one of some ids (all, if not given). Pictures aren't joined with pairs: a bitmap of
    pictures and blocks tells where each is needed, so that corners are shuffled once; two of the same bit move once more than needed.
    """
    if homes is None:
        blocks = np.array([r["block"] for r in pairs.select("block").distinct().collect()], np.int32)
        homes = lambda ids: (np.repeat(np.arange(len(ids)), len(blocks)), np.tile(blocks, len(ids)))
    both = lambda ids, block: hashed(ids + block.astype(np.int64) * -7046029254386353131)

    def needed(batches):
        for r in batches:
            b, a, block = (r.column(c).to_numpy() for c in ("b", "a", "block"))
            yield pa.RecordBatch.from_arrays(list(paged(np.r_[both(b, block), both(a, block)])), names=["key", "bits"])

    told = pictures.sparkSession.sparkContext.broadcast(squeeze(bitmap(pairs.mapInArrow(needed, "key bigint, bits binary"))))

    def spread(batches):
        bits = grown(told.value)
        for r in bites(batches, 1024):
            ids = r.column("id").to_numpy()
            row, block = homes(ids)
            use = has(bits, both(ids[row], block))
            row, block = row[use], block[use]
            for k in range(0, len(row), 4_096):
                own = row[k : k + 4_096]
                yield pa.RecordBatch.from_arrays([pa.array(block[k : k + 4_096]), pa.array(ids[own]), pa.nulls(len(own), pa.int64()), r.column("data").take(pa.array(own))], names=["block", "id", "other", "data"])

    rows = pictures.where("id IS NOT NULL").select("id", "data").mapInArrow(spread, "block int, id bigint, other bigint, data binary")
    return rows.union(pairs.select("block", F.col("b").alias("id"), F.col("a").alias("other"), F.lit(None).cast("binary").alias("data")))


def verified(pairs: DataFrame, pictures: DataFrame, weigh: Weights) -> DataFrame:
    """The pairs (b, a) whose corners agree on turn, scale and shift, in SHARE of b's weight or more. See Cells for how they are dealt."""
    spark = pairs.sparkSession
    told, n = spark.sparkContext.broadcast(weigh), shards(spark)

    def run(batches):
        lean(LARGE)
        data, b, a = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in batches:
            pair = r.column("other").is_valid().to_numpy(zero_copy_only=False)
            some = r.filter(pa.array(pair))
            b.append(some.column("id").to_numpy()), a.append(some.column("other").to_numpy())
            some = r.filter(pa.array(~pair))
            data.update(zip(some.column("id").to_pylist(), some.column("data").to_pylist()))
        b, a = np.concatenate(b), np.concatenate(a)
        order = np.lexsort((a, b))
        b, a = b[order], a[order]
        edges = np.r_[np.nonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])[0], len(b)].tolist()
        for k in range(0, len(edges) - 1, 256):
            some = edges[k : k + 257]
            own = [np.frombuffer(data[i], CORNER) for i in b[some[:-1]].tolist()]
            cut, every = np.cumsum([len(x) for x in own])[:-1], np.concatenate(own)
            weight, edge = told.value.of(every["d"]), at_edge(every, np.repeat(np.arange(len(own)), [len(x) for x in own]))
            keep = []
            for x, y, r, w, e in zip(some, some[1:], own, np.split(weight, cut), np.split(edge, cut)):
                ids = a[x:y].tolist()
                for first in range(0, len(ids), 1_000):
                    many = [np.frombuffer(data[i], CORNER) for i in ids[first : first + 1_000]]
                    for j in np.nonzero(hopeful([m["d"] for m in many], r["d"], w, e))[0].tolist():
                        agree, share = score(many[j], r, w, e)
                        if agree >= agreeing(len(r)) and share >= SHARE - 1e-9:
                            keep.append(x + first + j)
            yield pa.RecordBatch.from_arrays([pa.array(b[keep], pa.int64()), pa.array(a[keep], pa.int64())], names=["b", "a"])

    pairs = stored(pairs.select("b", "a"), "to-verify")
    size = pairs.agg(F.count("*").alias("n"), F.approx_count_distinct("b").alias("b"), F.approx_count_distinct("a").alias("a")).first()
    cells = Cells(n, size["n"], size["b"], size["a"], int(ROOM * weigh.pictures))
    out = []
    for turn in range(cells.passes):
        rows = moved(cells.dealt(pairs, turn), pictures, lambda ids, turn=turn: cells.homes(ids, turn))
        out.append(stored(rows.repartition(n, "block").mapInArrow(run, "b bigint, a bigint"), "linked"))
    return reduce(DataFrame.union, out)


def spread(n: int) -> int:
    """The number of blocks that make n / 2 pairs of two at most: what moves grows with it, and a session has more partitions than cores."""
    return max(1, int(((4 * n + 1) ** 0.5 + 1) / 2))


def cells(n: int) -> dict[tuple[int, int], int]:
    """A task for each two blocks, in both orders."""
    k = spread(n)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    return {p: i for i, (x, y) in enumerate(pairs) for p in ((x, y), (y, x))}


def block_of(ids: np.ndarray, k: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % np.uint64(k)).astype(np.int64)


#: Flags of a corner that moves: its turn, its scale, whether its keys may make two pictures meet, whether it is at_edge().
TURN, SCALE, USEFUL, EDGE = 15, 16, (32, 64), 128


def packed(ids: np.ndarray, n: np.ndarray, asked: np.ndarray, rows: np.ndarray, flags: np.ndarray) -> bytes:
    """Pictures with their corners, those that ask first: `asked` of n. opened() reads them."""
    columns = [ids, n.astype(np.int32), asked.astype(np.int32), rows["d"], rows["y"], rows["x"], flags]
    planes = (np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(ids), len(rows)]).tobytes() + b"".join(planes))


def opened(data: bytes) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 16, []
    sizes = raw[:16].view(np.int64).tolist()
    for kind, many in ((np.int64, 0), (np.int32, 0), (np.int32, 0), (np.uint64, 1), (np.int32, 1), (np.int32, 1), (np.uint8, 1)):
        k, m = np.dtype(kind).itemsize, sizes[many]
        out.append(np.ascontiguousarray(raw[at : at + m * k].reshape(k, m).T).view(kind).reshape(-1))
        at += m * k
    return out


def homes(block: int, n: int, alone: bool) -> tuple[list[int], list[bool]]:
    """The tasks that need a block, and whether it is the second of two there; alone: the one task that compares it with itself."""
    task = cells(n)
    others = [j for j in range(spread(n)) if j != block]
    return ([block], [False]) if alone else ([task[block, j] for j in others], [block > j for j in others])


#: Pictures, or ids with their roots, for a task: side is false for the first of two blocks.
MOVED = "part int, side boolean, data binary, roots binary"


def to_tasks(block: int, n: int, alone: bool, names: np.ndarray, data: bytes | None, roots: bytes | None) -> pa.RecordBatch:
    part, side = homes(block, n, alone)
    return pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(side, pa.bool_()), *(pa.array([x] * len(part), pa.binary()) for x in (data, roots))], names=["part", "side", "data", "roots"])


def blocks(pictures: DataFrame, weigh: Weights, alone: bool) -> DataFrame:
    """MOVED rows: pictures packed by block, a hash of the id, once for each task that needs them.

    An image asks with its weightiest corners, those that hold ASKED of its weight together; all its corners answer.
    """
    n = shards(pictures.sparkSession)
    k, names, told = spread(n), slots(n), pictures.sparkSession.sparkContext.broadcast(weigh)

    def run(batches):
        lean(LARGE)
        weigh = told.value
        for b in bites(batches, 2048):
            ids, n_corners, r = flat(b)
            if not len(ids):
                continue
            of, low, high = np.repeat(np.arange(len(ids)), n_corners), *keys(r["d"])
            asks = weigh.asking(r["d"], n_corners) > 0
            flags = (r["turn"] | r["scale"] * SCALE | weigh.useful(low) * np.uint8(USEFUL[0]) | weigh.useful(high) * np.uint8(USEFUL[1]) | at_edge(r, of) * np.uint8(EDGE)).astype(np.uint8)
            block = block_of(ids, k)
            order = np.lexsort((~asks, of, block[of]))
            r, flags, asked, at = r[order], flags[order], np.bincount(of, asks, minlength=len(ids)), 0
            for i in np.unique(block).tolist():
                own = np.nonzero(block == i)[0]
                end = at + int(n_corners[own].sum())
                yield to_tasks(i, n, alone, names, packed(ids[own], n_corners[own], asked[own], r[at:end], flags[at:end]), None)
                at = end

    return pictures.where("id IS NOT NULL").select("id", "n", "data").mapInArrow(run, MOVED)


class Forest:
    """Classes of numbers under links, of which those are kept that joined two."""

    def __init__(self, parent: np.ndarray):
        self.parent, self.links = parent.tolist(), []

    def top(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = i = p[p[i]]
        return i

    def join(self, b: np.ndarray, a: np.ndarray) -> None:
        for x, y in zip(b.tolist(), a.tolist()):
            i, j = self.top(x), self.top(y)
            if i != j:
                self.parent[max(i, j)] = min(i, j)
                self.links.append((x, y))

    def roots(self) -> np.ndarray:
        at = np.array(self.parent, np.int64)
        while (at[at] != at).any():
            at = at[at]
        return at


def runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All numbers of runs that have these lengths and starts."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def pieces(sizes: np.ndarray, most: int):
    """Bounds of runs of sizes that add up to about `most`, one size at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


class Meeting:
    """Pictures that meet in a task, in arrays, and the links found between them."""

    def __init__(self, parts: list[tuple[int, np.ndarray, list[np.ndarray]]], forest: Forest, weigh: Weights):
        """parts: side, numbers in the forest and opened() pictures; only pictures of two sides meet, or, if there is but one, all."""
        self.forest = forest
        self.side = np.concatenate([np.full(len(number), side) for side, number, _ in parts])
        self.number = np.concatenate([number for _, number, _ in parts])
        self.whole = bool((self.side == self.side[0]).all())
        columns = []
        for *_, (ids, n, asked, d, y, x, flags) in parts:
            start, of = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            weight, asks = weigh.of(d), np.arange(len(d)) - start[of] < asked[of]
            inner = np.where(flags & EDGE, 0, weight)
            sums = [np.add.reduceat(w, start) for w in (weight, np.where(asks, weight, 0), np.where(asks, inner, 0), inner)]
            columns.append((ids, n.astype(np.int64), asked.astype(np.int64), *sums, d, y, x, flags, weight, asks, surroundings(of, {"d": d, "y": y, "scale": (flags & SCALE > 0).astype(np.uint8)})))
        #: Of pictures: the weight of all corners and of those that ask, and the same without corners at an edge. Then of corners.
        self.ids, self.n, self.asked, self.all, self.some, self.some_inner, self.inner, self.d, self.y, self.x, self.flags, self.weight, self.asks, self.around = (np.concatenate(c) for c in zip(*columns))
        self.start, self.of = np.cumsum(self.n) - self.n, np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        #: Of two pictures the one of lower rank asks.
        self.rank = np.empty(len(self.n), np.int64)
        self.rank[np.lexsort((-self.ids, self.n))] = np.arange(len(self.n))
        self.compared = 0

    def table(self, t: int) -> dict[str, np.ndarray]:
        """Corners that may meet under keys of a table (0 or 1), sorted by key: their places, the numbers of their keys, their other halves."""
        half = self.d.view(np.uint32).reshape(-1, 2)
        at = np.nonzero(self.flags & USEFUL[t])[0].astype(np.int32)
        key = half[at, t]
        order = np.argsort(key)
        at, key = at[order], key[order]
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]], dtype=np.int32)[: len(at)]
        size, left = np.bincount(group), np.bincount(group, self.side[self.of[at]])
        keep = (size > 1) & (np.bincount(group, self.asks[at]) > 0) & (self.whole | ((left > 0) & (left < size)))
        group, at = (np.cumsum(keep, dtype=np.int32) - 1)[group[keep[group]]], at[keep[group]]
        return {"at": at, "group": group, "other": half[at, 1 - t]}

    def met(self, e: dict[str, np.ndarray], t: int, x: np.ndarray, low: np.ndarray, high: np.ndarray, root: np.ndarray):
        """Numbers b * pictures + a of pictures in no class together, of which entry x of b and one of low to high (not included), of a, may be the same corner."""
        some = high > low
        x, low, high = x[some], low[some], high[some]
        for a, b in pieces(high - low, 300_000):
            many = high[a:b] - low[a:b]
            y = runs(many, low[a:b])
            off = np.bitwise_count(np.repeat(e["other"][x[a:b]], many) ^ e["other"][y])
            # equal in both halves: the first table has it
            near = np.flatnonzero(off <= BITS if t == 0 else (off <= BITS) & (off > 0))
            p, q = e["at"][np.repeat(x[a:b], many)[near]], e["at"][y[near]]
            near = np.bitwise_count(self.around[p] ^ self.around[q]) <= FAR
            p, q = self.of[p[near]].astype(np.int64), self.of[q[near]]
            near = (self.rank[p] < self.rank[q]) & (root[p] != root[q])
            if not self.whole:
                near &= self.side[p] != self.side[q]
            yield p[near] * len(self.n) + q[near]

    def root(self) -> np.ndarray:
        return self.forest.roots()[self.number]

    def settle(self, found: list[np.ndarray]) -> None:
        """Compares pairs that met: one of each picture that asks first, that which met most often, then twice as many each time, always those that no link has connected."""
        code, times = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        b, a = code // max(1, len(self.n)), code % max(1, len(self.n))
        order = np.lexsort((-times, b))
        b, a, take = b[order], a[order], 1
        while len(b):
            root = self.root()
            apart = root[b] != root[a]
            b, a = b[apart], a[apart]
            place = np.arange(len(b)) - np.searchsorted(b, b, "left")
            now = place < take
            self.compare(b[now], a[now])
            b, a, take = b[~now], a[~now], 4 * take

    def links(self, dense: int) -> None:
        """Adds to the forest what links all that are linked: first by keys of few entries, then by others, under which each entry first meets few."""
        tables, found, held = [], [], 0
        for t in (0, 1):
            e = self.table(t)
            size = np.bincount(e["group"])
            first, small = np.cumsum(size) - size, size[e["group"]] <= SPLIT
            x = np.nonzero(self.asks[e["at"]] & small)[0]
            for code in self.met(e, t, x, first[e["group"][x]], (first + size)[e["group"][x]], self.root()):
                found.append(code)
                held += len(code)
                if held > 1_000_000:
                    self.settle(found)
                    found, held = [], 0
            tables.append({c: v[~small] for c, v in e.items()})
        self.settle(found)
        rng = np.random.default_rng(0)
        for take in (*sorted({1, max(1, dense // 4), dense}), 0):
            for t, e in enumerate(tables):
                self.large(e, t, take, rng)

    def large(self, e: dict[str, np.ndarray], t: int, take: int, rng: np.random.Generator) -> None:
        """Compares pictures that meet under keys of many entries, `take` of an entry and in no class with it, or all (0)."""
        root = self.root()
        of = self.of[e["at"]]
        where = (e["group"] * np.int64(2) + self.side[of]) << 32 | root[of]
        order = np.argsort(where)
        e, where = {c: v[order] for c, v in e.items()}, where[order]
        x = np.nonzero(self.asks[e["at"]])[0]
        own = where[x] & 0xFFFFFFFF
        to = where[x] >> 32 if self.whole else where[x] >> 32 ^ 1
        # all of the other side but those of the same root, who stand together
        bounds = [np.searchsorted(where, v) for v in (to << 32, to << 32 | own, (to << 32 | own) + 1, (to + 1) << 32)]
        if take:
            left = bounds[1] - bounds[0] >= bounds[3] - bounds[2]
            low, high = np.where(left, bounds[0], bounds[2]), np.where(left, bounds[1], bounds[3])
            low = low + (rng.random(len(x)) * np.maximum(0, high - low - take + 1)).astype(np.int64)
            high = np.minimum(low + take, high)
        else:
            x, low, high = np.r_[x, x], np.r_[bounds[0], bounds[2]], np.r_[bounds[1], bounds[3]]
        found, held = [], 0
        for code in self.met(e, t, x, low, high, root):
            found.append(code)
            held += len(code)
            if held > 1_000_000:
                self.settle(found)
                found, held, root[:] = [], 0, self.root()
        self.settle(found)

    def compare(self, b: np.ndarray, a: np.ndarray) -> None:
        """Links pictures b (sorted) and a whose corners agree, see score(); most can be told from the corners that ask."""
        self.compared += len(b)
        hope = [i + np.nonzero(self.near(b[i:j], a[i:j], True)[0])[0] for i, j in pieces(self.n[a], 500_000)]
        hope = np.concatenate([np.zeros(0, np.int64), *hope])
        b, a = b[hope], a[hope]
        for i, j in pieces(self.n[a], 200_000):
            hope, whole, pair, q, p = self.near(b[i:j], a[i:j])
            own = hope[pair]
            agree, share = self.agreement(j - i, pair[own], q[own], p[own], whole)
            own = (agree >= agreeing(self.n[b[i:j]])) & (share >= SHARE - 1e-9)
            self.forest.join(self.number[b[i:j][own]], self.number[a[i:j][own]])

    def near(self, b: np.ndarray, a: np.ndarray, asked: bool = False) -> tuple[np.ndarray, ...]:
        """Whether pairs may reach SHARE, by those corners of each b that ask only (asked; as if all others matched) or by all; the weight that a share is of; and all matches: the place of the pair, the corner of b and that of a."""
        m = self.n[a]
        ends = np.cumsum(m)
        at = runs(m, self.start[a])
        d, k = self.d[at], (self.asked if asked else self.n)[b]
        first, size, bounds = self.start[b].tolist(), k.tolist(), [0, *ends.tolist()]
        found, where = [], []
        edges = np.r_[np.nonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])[0], len(b)].tolist()
        for x, y in zip(edges, edges[1:]):
            own = self.d[first[x] : first[x] + size[x], None]
            for lo, hi in pieces(m[x:y], 150_000 // size[x]) if (bounds[y] - bounds[x]) * size[x] > 150_000 else ((0, y - x),):
                z, e = bounds[x + lo], bounds[x + hi]
                found.append(np.flatnonzero(np.bitwise_count(own ^ d[z:e]) <= BITS))
                where.append((len(found[-1]), e - z, z, first[x]))
        n, width, z, top = np.array(where, np.int64).reshape(-1, 4).T
        match = np.concatenate([np.zeros(0, np.int64), *found])
        q = match // np.repeat(width, n)
        p = match - q * np.repeat(width, n) + np.repeat(z, n)
        q += np.repeat(top, n)
        pair = np.repeat(np.arange(len(a)), m)[p]
        # matches of a pair and a corner of b stand together
        new = np.r_[True, (q[1:] != q[:-1]) | (pair[1:] != pair[:-1])][: len(q)]
        w, e = self.weight[q[new]], self.flags[q[new]] & EDGE > 0
        got, out = np.bincount(pair[new], w, len(a)), np.bincount(pair[new], np.where(e, 0, w), len(a))
        rest = (self.all - self.some)[b] if asked else 0
        whole = got + (self.some_inner if asked else self.inner)[b] - out + rest
        return got + rest >= (SHARE - 1e-6) * whole, whole, pair, q, at[p]

    def agreement(self, n: int, pair: np.ndarray, q: np.ndarray, p: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """score() of n pairs at once: pair, the corner of b and that of a of each match, and the weight that a pair's share is of."""
        where = bins(*({"y": self.y[i], "x": self.x[i], "scale": self.flags[i] & SCALE > 0, "turn": self.flags[i] & TURN} for i in (p, q)))
        order = np.lexsort((q, where, pair))
        pair, q, where = pair[order], q[order], where[order]
        # a corner of b votes once in a bin, and counts once however many bins it is in
        new = np.r_[True, (pair[1:] != pair[:-1]) | (where[1:] != where[:-1]) | (q[1:] != q[:-1])][: len(q)]
        pair, q, where = pair[new], q[new], where[new]
        at = np.cumsum(np.r_[False, (pair[1:] != pair[:-1]) | (where[1:] != where[:-1])])[: len(q)]
        use = (np.bincount(at) >= LEAST_BIN)[at]
        both = np.unique(np.stack([pair[use], q[use]]), axis=1)
        return np.bincount(both[0], minlength=n), np.bincount(both[0], self.weight[both[1]], minlength=n) / np.maximum(1e-300, whole)


def copies_in(one: list[bytes], two: list[bytes], known: list[bytes], weigh: Weights, dense: int = 16) -> tuple[np.ndarray, Forest]:
    """ids, and a forest (of places in them) of links that connect all that is linked between packed() pictures: those of one with those of two, or, without two, among themselves.

    known: ids and roots of classes that are connected already. So many corners as HELD are in arrays at a time, twice; the others stay packed.
    """
    ids, parts = [np.zeros(0, np.int64)], []
    for side, many in enumerate((one, two)):
        held = HELD
        for data in many:
            own, n = opened(data)[:2]
            held += int(n.sum())
            if held > HELD:
                parts.append([])
                held = int(n.sum())
            parts[-1].append((side, sum(map(len, ids)) + np.arange(len(own)), data))
            ids.append(own)
    ids = np.concatenate(ids)
    parent, order = np.arange(len(ids)), np.argsort(ids, kind="stable")
    for data in known:
        own, root = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64).reshape(2, -1)
        parent[order[np.searchsorted(ids, own, sorter=order)]] = order[np.searchsorted(ids, root, sorter=order)]
    forest = Forest(parent)
    for i, x in enumerate(parts):
        for y in parts[i:]:
            if two and x[0][0] == y[0][0]:
                continue
            got = x if x is y else [(k, *rest) for k, part in enumerate((x, y)) for _, *rest in part]
            Meeting([(side, number, opened(data)) for side, number, data in got], forest, weigh).links(dense)
    return ids, forest


def links(pictures: DataFrame, dense: int = 16) -> DataFrame:
    """b, a: links of pictures(id, n, data), enough to connect all that are linked. All pictures that meet are compared, unless links have connected them already.

    Pairs don't leave their task, which holds a block of pictures, or two of them once each has been compared with itself; it gives a forest of links.
    dense: how many an entry first meets under a key of more than SPLIT.
    """
    spark = pictures.sparkSession
    n = shards(spark)
    weigh, k, names = weights(pictures), spread(n), slots(n)
    parts = [blocks(pictures, weigh, alone) for alone in (True, False)]
    weigh.several = np.zeros(0, np.uint8)  # what follows doesn't need it
    told = spark.sparkContext.broadcast(weigh)

    def run(batches):
        lean(LARGE)
        sides, known = ([], []), []
        for r in batches:
            for side, data, roots in zip(*(r.column(c).to_pylist() for c in ("side", "data", "roots"))):
                sides[side].append(data) if roots is None else known.append(roots)
        if any(sides):
            ids, forest = copies_in(*sides, known, told.value, dense)
            b, a = ids[np.array(forest.links, np.int64).reshape(-1, 2)].T
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), pa.nulls(len(b), pa.binary())], names=["b", "a", "roots"])
            yield pa.RecordBatch.from_arrays([pa.array([ids[0]]), pa.nulls(1, pa.int64()), pa.array([squeeze(np.stack([ids, ids[forest.roots()]]))], pa.binary())], names=["b", "a", "roots"])

    def known(batches):
        for r in batches:
            for i, roots in zip(r.column("b").to_numpy(), r.column("roots").to_pylist()):
                yield to_tasks(int(block_of(np.array([i]), k)[0]), n, False, names, None, roots)

    found = "b bigint, a bigint, roots binary"
    alone = stored(parts[0].repartition(n, "part").mapInArrow(run, found), "linked")
    if k == 1:
        return alone.where("a IS NOT NULL").select("b", "a")
    both = parts[1].union(alone.where("roots IS NOT NULL").mapInArrow(known, MOVED))
    two = stored(both.repartition(n, "part").mapInArrow(run, found), "linked")
    return alone.union(two).where("a IS NOT NULL").select("b", "a")


def image_copies(images: DataFrame) -> DataFrame:
    """id, n_corners, class_id (the least id of its class) for each row of images(id bigint, image binary)."""
    found = stored(corners(images), "corners", "zstd")
    size = found.groupBy("id").agg(F.sum("n").cast("bigint").alias("n_corners"))
    some = found.where("id IS NOT NULL AND pixels IS NOT NULL")
    # equal images are one picture, that of the least id, and link to it whatever corners they have
    first = some.groupBy("pixels").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1")
    same = stored(some.select("id", "pixels").join(first, "pixels").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct(), "equal")
    pictures = join_small(some.drop("pixels"), same.where("u <> v").select(F.col("u").alias("id")).distinct(), ["id"], "left_anti")
    near = links(pictures).select(F.col("b").alias("u"), F.col("a").alias("v")).union(same)
    root = components(near)
    out = images.select("id").join(size, "id", "left").join(root.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", F.coalesce("n_corners", F.lit(0)).cast("bigint").alias("n_corners"), F.coalesce("root", "id").alias("class_id"))


def rasters(pages: DataFrame, id_column: str = "page_id", text: str = "html") -> DataFrame:
    """id, image: a media column made of a text column; a null text gives a null image."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if t is None else raster(t) for t in b.column("t").to_pylist()], pa.binary())], names=["id", "image"])

    return pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "id bigint, image binary")
