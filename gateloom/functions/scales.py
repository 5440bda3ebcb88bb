"""Axis scales with parameters, as column expressions and for numbers: what a workspace file says of its channels."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gateloom.functions.scalars import Logicle


@dataclass(frozen=True)
class Scale:
    """kind and parameters. All are monotone and finite on all numbers:

    linear (low, high): (x - low) / (high - low).
    log (offset, decades): 1 + log10(x / top) / decades with top = offset * 10**decades; values below offset count as offset.
    asinh (top, decades, negative): the parametrised inverse hyperbolic sine of the gating standard.
    logicle (top, width, decades, negative): the biexponential of Parks, Roederer and Moore.
    """

    kind: str = "linear"
    parameters: tuple[float, ...] = (0.0, 1.0)

    @staticmethod
    def biex(top: float, width: float, decades: float, negative: float) -> Scale:
        """The biexponential by its basis of negative width: a logicle of half its logarithm."""
        return Scale("logicle", (top, math.log10(max(-width, 1.0)) / 2, decades, negative))

    @cached_property
    def _logicle(self) -> Logicle:
        return Logicle(*self.parameters)

    def _asinh(self) -> tuple[float, float, float]:
        top, decades, negative = self.parameters
        return math.sinh(decades * math.log(10)) / top, negative * math.log(10), (decades + negative) * math.log(10)

    def column(self, x: Column) -> Column:
        p = self.parameters
        if self.kind == "linear":
            return (x - F.lit(p[0])) / F.lit(p[1] - p[0])
        if self.kind == "log":
            return F.log10(F.greatest(x, F.lit(p[0])) / F.lit(p[0] * 10 ** p[1])) / F.lit(p[1]) + F.lit(1.0)
        if self.kind == "asinh":
            factor, shift, whole = self._asinh()
            return (F.asinh(x * F.lit(factor)) + F.lit(shift)) / F.lit(whole)
        if self.kind == "logicle":
            return self._logicle.forward(x)
        raise ValueError(f"unknown scale {self.kind}")

    def of(self, x) -> np.ndarray:
        """The same of numbers."""
        x, p = np.asarray(x, float), self.parameters
        if self.kind == "linear":
            return (x - p[0]) / (p[1] - p[0])
        if self.kind == "log":
            return np.log10(np.maximum(x, p[0]) / (p[0] * 10 ** p[1])) / p[1] + 1.0
        if self.kind == "asinh":
            factor, shift, whole = self._asinh()
            return (np.arcsinh(x * factor) + shift) / whole
        if self.kind == "logicle":
            return self._logicle.forward_of(x)
        raise ValueError(f"unknown scale {self.kind}")
