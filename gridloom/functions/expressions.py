"""Algebraic expressions of variable names (``derived = rsus/rsds``) to columns, with the unit of the result."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import conversion, inverse, multiply

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|(\*\*|[-+*/()^]))")


def names(expression: str) -> list[str]:
    """The variables of an expression, in order of appearance."""
    return list(dict.fromkeys(m[2] for m in _TOKEN.finditer(expression) if m[2]))


class _Parser:
    def __init__(self, expression: str, columns: dict[str, Column], units: dict[str, str]):
        self.tokens = [m.groups() for m in _TOKEN.finditer(expression)]
        if "".join(x for t in self.tokens for x in t if x) != re.sub(r"\s", "", expression):
            raise ValueError(f"cannot read {expression!r}")
        self.at, self.columns, self.units = 0, columns, units

    def sign(self) -> str | None:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else None

    def sum(self) -> tuple[Column, str]:
        left, unit = self.product()
        while self.sign() in ("+", "-"):
            plus = self.sign() == "+"
            self.at += 1
            right, own = self.product()
            if own != unit:
                scale, offset = conversion(own, unit)
                right = right * scale + offset
            left = left + right if plus else left - right
        return left, unit

    def product(self) -> tuple[Column, str]:
        left, unit = self.power()
        while self.sign() in ("*", "/"):
            times = self.sign() == "*"
            self.at += 1
            right, own = self.power()
            left = left * right if times else F.try_divide(left, right)
            unit = multiply(unit, own if times else inverse(own))
            if not times and own and self._same(unit):
                unit = "1"
        return left, unit

    @staticmethod
    def _same(unit: str) -> bool:
        try:
            return conversion(unit, "1")[0] == 1.0
        except ValueError:
            return False

    def power(self) -> tuple[Column, str]:
        base, unit = self.atom()
        if self.sign() in ("**", "^"):
            self.at += 1
            times = float(self.tokens[self.at][0])
            self.at += 1
            return F.pow(base, F.lit(times)), " ".join([unit] * int(times)) if unit != "1" else unit
        return base, unit

    def atom(self) -> tuple[Column, str]:
        number, name, sign = self.tokens[self.at]
        self.at += 1
        if number:
            return F.lit(float(number)), "1"
        if name:
            return self.columns[name], self.units.get(name, "1")
        if sign == "-":
            value, unit = self.atom()
            return -value, unit
        if sign != "(":
            raise ValueError(f"unexpected {sign!r}")
        out = self.sum()
        self.at += 1
        return out


def compile_expression(expression: str, columns: dict[str, Column], units: dict[str, str] | None = None) -> tuple[Column, str]:
    """The column of an expression and its unit; sums convert their terms to the first one's unit. NaN becomes null."""
    parser = _Parser(expression, columns, units or {})
    value, unit = parser.sum()
    if parser.at != len(parser.tokens):
        raise ValueError(f"cannot read {expression!r}")
    return F.nanvl(value.cast("double"), F.lit(None).cast("double")), unit
