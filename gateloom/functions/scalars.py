"""Scalar functions: names, roles, formats, axis transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: patterns and tables that results depend on ----
SCATTER = "(?i)FSC|SSC|Time|Width|Event"
DNA = "(?i)PI|DAPI|7.?AAD|Hoechst|DNA|FxCycle|DRAQ"
UNSTAINED = r"(?i)unstain|\bblank\b|no.?stain|^\s*un\b"
FLUOR = (
    r"(?i)FITC|PerCP|PE.?Cy7|PE.?CF594|\bPE\b|APC.?Cy7|APC.?H7|\bAPC\b|AF700|AL700|A700|Alexa.?Fluor.?700|BV421|BV510|BV605|BV650|BV711|BV786|"
    r"BUV395|BUV737|Pacific.?Blue|eFluor|PerCP.?Cy5|7.?AAD|Zombie|DAPI|\bPI\b"
)
NOT_SINGLE = r"(?i)FMO|multi.?stain|cocktail|full.?stain|\bG1\b|\bG2\b|\bS\b.?phase"
EMISSION = {
    "fitc": 519, "alexafluor488": 519, "af488": 519, "cfse": 517, "gfp": 509, "pe": 578, "pe-cf594": 615, "pe-dazzle594": 615, "percp": 677,
    "percp-cy5.5": 695, "pe-cy5": 667, "pe-cy7": 780, "apc": 660, "alexafluor647": 668, "af647": 668, "alexafluor700": 723, "af700": 723,
    "apc-cy7": 780, "apc-h7": 780, "apc-fire750": 787, "bv421": 421, "pacificblue": 455, "bv510": 510, "bv570": 570, "bv605": 605, "bv650": 650,
    "bv711": 711, "bv785": 785, "buv395": 395, "buv737": 737, "pi": 617, "7-aad": 647, "dapi": 461,
}
ONTOLOGY = {
    "lymph": "Lymphocytes", "tcell": "T cells", "cd4": "CD4+ T helper", "cd8": "CD8+ cytotoxic T", "treg": "Regulatory T cells", "naive": "Naïve T cells",
    "memory": "Memory T cells", "bcell": "B cells", "plasma": "Plasmablasts", "nk": "NK cells", "nkt": "NKT cells", "mono": "Monocytes",
    "classical": "Classical monocytes", "dc": "Dendritic cells", "neut": "Neutrophils", "eos": "Eosinophils", "baso": "Basophils", "live": "Live cells",
    "single": "Single cells", "blast": "Blasts", "stem": "Hematopoietic stem",
}
OTHER_SPELLINGS = {"helper": "cd4", "cytotox": "cd8", "singlet": "single", "viable": "live"}
# ---- end of fixed values ----


def is_scatter(name: Column) -> Column:
    return name.rlike(SCATTER)


def short_name(name: Column, most: int | None = None) -> Column:
    """Without .fcs; cut to most - 1 characters and an ellipsis if it is longer."""
    out = F.regexp_replace(name, r"(?i)\.fcs$", "")
    return out if most is None else F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 1), F.lit("…"))).otherwise(out)


def first_contained(text: Column, keys: Sequence[str], values: Sequence) -> Column:
    """The value of the first key that text contains."""
    out = F.lit(None)
    for k, v in reversed(list(zip(keys, values))):
        out = F.when(text.contains(k), F.lit(v)).otherwise(out)
    return out


def fluorochrome(name: Column, longest: bool = False) -> Column:
    """The fluorochrome in a channel's name: the first of the table, or the longest."""
    keys = sorted(EMISSION, key=lambda k: -len(k)) if longest else list(EMISSION)
    return first_contained(F.regexp_replace(F.lower(name), r"[\s\-]", ""), [k.replace("-", "") for k in keys], keys)


def emission(fluor: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in EMISSION.items() for x in kv])[fluor]


def ontology(name: Column) -> Column:
    """The cell type that a population's name points to, else null."""
    keys = [*ONTOLOGY, *OTHER_SPELLINGS]
    return first_contained(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), keys, [*ONTOLOGY.values(), *(ONTOLOGY[v] for v in OTHER_SPELLINGS.values())])


def control_roles(samples: DataFrame, name: str, order: str) -> DataFrame:
    """samples with role: the first unstained one, single stains, and those to ignore."""
    un = samples.where(F.col(name).rlike(UNSTAINED)).agg(F.min(order)).first()[0]
    role = F.when(F.col(order) == F.lit(un), "Unstained") if un is not None else F.when(F.lit(False), "")
    return samples.withColumn("role", role.when(~F.col(name).rlike(NOT_SINGLE) & F.col(name).rlike(FLUOR), "Single stain").otherwise("Ignore"))


def positivity_role(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("unstain") | low.contains("blank") | low.contains("negative"), "Unstained").when(low.contains("fmo"), "FMO").otherwise("Sample")


def keyword(name: Column) -> Column:
    """Lower case, one leading $ stripped."""
    return F.regexp_replace(F.lower(name), r"^\$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def as_text(x: Column, form: str) -> Column:
    """Numbers by a printf form as C writes them, rounded by their exact binary value, ties to even; Java's format_string rounds ties up."""
    return F.udf(lambda v: None if v is None else form % v, "string", useArrow=True)(x)


def scientific(x: Column) -> Column:
    """Two digits after the point and an exponent."""
    return as_text(x, "%.2e")


def intensity(x: Column) -> Column:
    """Scientific from 1e5 on and below 0.01 (but 0), else a grouped whole number; -0 for what rounds up to 0."""
    a = F.abs(x)
    whole = F.when((x > -0.5) & (x < 0), "-0").otherwise(F.format_number(F.round(x, 0).cast("bigint"), 0))
    return F.when((a >= 1e5) | ((a < 0.01) & (x != 0)), scientific(x)).otherwise(whole)


def csv_quoted(text: Column) -> Column:
    return F.when(text.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def display_scale(name: Column, chosen: Column | None = None) -> Column:
    default = F.when(is_scatter(name), "Linear").otherwise("Biex")
    return default if chosen is None else F.coalesce(chosen, default)


def without_count(name: Column) -> Column:
    """A legend's name without the count in brackets at its end."""
    return F.regexp_replace(name, r"\s*\([\d,]+\)\s*$", "")


def asinh(x: Column, cofactor: float = 150.0) -> Column:
    return F.asinh(x / F.lit(max(1e-9, cofactor)))


def asinh_inverse(t: Column, cofactor: float = 150.0) -> Column:
    return F.sinh(t) * F.lit(max(1e-9, cofactor))


def log_display(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1.0)))


def log_scaled(x: Column, top: float = 262144.0, decades: float = 4.5) -> Column:
    """The parametrised logarithm of the gating standard; null at 0 and below."""
    return F.log10(F.when(x > 0, x) / F.lit(top)) / F.lit(decades) + F.lit(1.0)


def auto_width(least: Column, top: Column) -> Column:
    """The width of the logicle's linear part from the least value."""
    return F.greatest(F.lit(0.05), F.least(F.lit(2.24), (F.lit(4.5) - F.log10(top / F.abs(F.least(least, F.lit(-1.0))))) / 2))


class Logicle:
    """The logicle scale of Parks, Roederer and Moore (2006): display = root of a biexponential."""

    def __init__(self, top: float = 262144.0, width: float = 0.5, decades: float = 4.5, negative: float = 0.0):
        total = decades + negative
        w = width / total
        x2 = negative / total
        self.x1, x0 = x2 + w, x2 + 2 * w
        self.b = total * math.log(10)
        self.d = self._slope(w)
        grown = math.exp(x0 * (self.b + self.d))
        shift = math.exp(self.b * self.x1) - grown / math.exp(self.d * self.x1)
        self.a = top / (math.exp(self.b) - shift - grown / math.exp(self.d))
        self.c, self.f = grown * self.a, shift * self.a

    def _slope(self, w: float) -> float:
        """d solves 2 ln(d / b) + w (b + d) = 0: Newton's method kept within a bracket."""
        if w == 0:
            return self.b
        lo, hi, d = 0.0, self.b, self.b / 2
        for _ in range(200):
            g = 2 * math.log(d / self.b) + w * (self.b + d)
            lo, hi = (lo, d) if g > 0 else (d, hi)
            nxt = d - g / (2 / d + w)
            new = nxt if lo < nxt < hi else (lo + hi) / 2
            if new == d:
                break
            d = new
        return d

    def inverse(self, s: Column) -> Column:
        """Data value of a display value, as one expression."""
        far = F.lit(self.x1) + F.abs(s - F.lit(self.x1))  # antisymmetric about the display value of 0
        return F.signum(s - F.lit(self.x1)) * (F.lit(self.a) * F.exp(F.lit(self.b) * far) - F.lit(self.c) * F.exp(F.lit(-self.d) * far) - F.lit(self.f))

    def inverse_of(self, s):
        s = np.asarray(s, float)
        far = self.x1 + np.abs(s - self.x1)
        return np.sign(s - self.x1) * (self.a * np.exp(self.b * far) - self.c * np.exp(-self.d * far) - self.f)

    def forward(self, x: Column, steps: int = 60) -> Column:
        """Display value: bisection on [-0.8, 1.2] as a fold, so it stays in the JVM; clamped there."""
        start = F.struct(F.lit(-0.8).alias("lo"), F.lit(1.2).alias("hi"))

        def halve(a: Column, _: Column) -> Column:
            mid = (a["lo"] + a["hi"]) / 2
            high = self.inverse(mid) > x
            return F.struct(F.when(high, a["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(a["hi"]).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2)

    def forward_of(self, x, steps: int = 60):
        x = np.asarray(x, float)
        lo, hi = np.full(x.shape, -0.8), np.full(x.shape, 1.2)
        for _ in range(steps):
            mid = (lo + hi) / 2
            high = self.inverse_of(mid) > x
            lo, hi = np.where(high, lo, mid), np.where(high, mid, hi)
        return (lo + hi) / 2


def phase_bounds(m1: Column, s1: Column, m2: Column, s2: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Where G1 ends and G2 begins: 1.5 deviations from the peaks, the middle if they overlap, within the data."""
    a, b = m1 + s1 * 1.5, m2 - s2 * 1.5
    mid = (a + b) / 2
    clamp = lambda v: F.greatest(lo, F.least(hi, v))
    return clamp(F.when(a >= b, mid).otherwise(a)), clamp(F.when(a >= b, mid).otherwise(b))


def spill(text: Column) -> tuple[Column, Column]:
    """Channels and row-major coefficients of a spillover keyword: n, n names, n x n numbers."""
    parts = F.split(text, r"\s*,\s*")
    n = F.element_at(parts, 1).cast("int")
    return F.slice(parts, F.lit(2), n), F.transform(F.slice(parts, n + 2, n * n), lambda v: v.cast("double"))


def to_pixel(v: Column, lo: float, hi: float, size: float, flip: bool = False) -> Column:
    at = (v - F.lit(lo)) / F.lit(hi - lo) * F.lit(size)
    return F.lit(size) - at if flip else at


def to_data(p: Column, lo: float, hi: float, size: float, flip: bool = False) -> Column:
    at = F.lit(size) - p if flip else p
    return F.lit(lo) + at / F.lit(size) * F.lit(hi - lo)


def unit_range(v: Column, lo: Column, hi: Column) -> Column:
    """v on [0, 1]; 0.5 if there is no range."""
    return F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))).otherwise(F.lit(0.5))
