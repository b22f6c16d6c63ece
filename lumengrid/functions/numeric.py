"""Scalar formulas that Spark and DuckDB read alike.

A formula is written once over a dialect, so that both engines get the same tree of 32-bit operations: every literal and
every quotient is cast to FLOAT, float-to-integer conversion truncates, and powers go through DOUBLE and back.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    def f(self, x) -> str:
        return f"CAST({x} AS FLOAT)"

    def div(self, a: str, b: str) -> str:
        return f"CAST(({a}) / ({b}) AS FLOAT)"

    def trunc(self, x: str) -> str:
        return f"CAST({x} AS INT)" if self.name == "spark" else f"CAST(trunc({x}) AS INT)"

    def clamp(self, x: str, low="0", high="255") -> str:
        return f"least({self.f(high)}, greatest({self.f(low)}, {x}))"

    def byte(self, x: str) -> str:
        """A sample from 0 to 255: clamped, then truncated."""
        return self.trunc(self.clamp(x))

    def pow(self, x: str, p: float | str) -> str:
        return f"CAST(pow(CAST({x} AS DOUBLE), CAST({self.f(p)} AS DOUBLE)) AS FLOAT)"

    def exp(self, x: str) -> str:
        return f"CAST(exp(CAST({x} AS DOUBLE)) AS FLOAT)"

    def sqrt(self, x: str) -> str:
        return f"CAST(sqrt(CAST({x} AS DOUBLE)) AS FLOAT)"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.name == "spark" else f"(({a}) // ({b}))"

    def mod2(self, x: str) -> str:
        """x modulo 2 of a float."""
        return f"pmod({x}, {self.f(2)})" if self.name == "spark" else f"(({x}) - {self.f(2)} * floor(({x}) / {self.f(2)}))"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def weighted(d: Dialect, weights: list, channels: list[str], offset=None) -> str:
    """The sum of weight * channel, in order, in FLOAT."""
    terms = " + ".join(f"{d.f(w)} * {d.f(c)}" for w, c in zip(weights, channels, strict=True))
    return f"({terms}" + (f" + {d.f(offset)})" if offset is not None else ")")
