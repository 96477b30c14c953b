"""A small unit algebra: products of powers of named units, with prefixes, factors and the degree Celsius' offset.

``parse`` turns a unit string into (dimensions, scale, offset) relative to SI base units; ``conversion`` gives the
``value * scale + offset`` between two units, which becomes two literals in a projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The units that data files name, their SI factors and dimensions.
YEAR_SECONDS = 365.242198781 * 86400
BASE = ("kg", "m", "s", "K", "mol", "A")
UNITS: dict[str, tuple[float, dict[str, int]]] = {
    "g": (1e-3, {"kg": 1}), "m": (1.0, {"m": 1}), "s": (1.0, {"s": 1}), "K": (1.0, {"K": 1}), "mol": (1.0, {"mol": 1}), "A": (1.0, {"A": 1}),
    "d": (86400.0, {"s": 1}), "day": (86400.0, {"s": 1}), "days": (86400.0, {"s": 1}), "h": (3600.0, {"s": 1}), "hour": (3600.0, {"s": 1}), "min": (60.0, {"s": 1}),
    "yr": (YEAR_SECONDS, {"s": 1}), "year": (YEAR_SECONDS, {"s": 1}), "months": (YEAR_SECONDS / 12, {"s": 1}), "month": (YEAR_SECONDS / 12, {"s": 1}),
    "W": (1.0, {"kg": 1, "m": 2, "s": -3}), "J": (1.0, {"kg": 1, "m": 2, "s": -2}), "N": (1.0, {"kg": 1, "m": 1, "s": -2}), "Pa": (1.0, {"kg": 1, "m": -1, "s": -2}),
    "ha": (1e4, {"m": 2}), "l": (1e-3, {"m": 3}), "t": (1e3, {"kg": 1}), "degC": (1.0, {"K": 1}), "celsius": (1.0, {"K": 1}), "%": (1e-2, {}), "psu": (1e-3, {}), "ppm": (1e-6, {}), "radian": (1.0, {}), "degree": (0.017453292519943295, {}), "degrees": (0.017453292519943295, {}),
}
PREFIXES = {"P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9}
CELSIUS = 273.15
WATER_DENSITY, CARBON_MOLAR_MASS = 998.2, 12.0107
PLAIN = {"", "1", "unitless", "n/a", "none", "-"}
_TOKEN = re.compile(r"\s*([*/.]?)\s*(?:([-+]?\d+\.?\d*(?:[eE][-+]?\d+)?)|([A-Za-z%]+))(?:\s*(?:\^|\*\*)?\s*([-+]?\d+))?")


class UnknownUnit(ValueError):
    """A unit string that cannot be read."""


class UnitConversionError(ValueError):
    """Two units of different dimensions that no bridge connects."""


@dataclass(frozen=True)
class Unit:
    scale: float
    dims: dict[str, int] = field(default_factory=dict)
    offset: float = 0.0


def _named(name: str) -> tuple[float, dict[str, int]]:
    if name in UNITS:
        return UNITS[name]
    if name[:1] in PREFIXES and name[1:] in UNITS:
        scale, dims = UNITS[name[1:]]
        return PREFIXES[name[0]] * scale, dims
    raise UnknownUnit(name)


def parse(text: str) -> Unit:
    text = text.strip()
    if text.lower() in PLAIN:
        return Unit(1.0)
    if text in ("degC", "celsius"):
        return Unit(1.0, {"K": 1}, CELSIUS)
    scale, dims, at = 1.0, dict[str, int](), 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise UnknownUnit(text)
        sign = -1 if found[1] == "/" else 1
        if found[2] is not None:
            power = sign * int(found[4] or 1) if found[1] != "" or found[4] else sign
            scale *= float(found[2]) ** power
        else:
            power = sign * int(found[4] or 1)
            factor, own = _named(found[3])
            scale *= factor**power
            for d, p in own.items():
                dims[d] = dims.get(d, 0) + p * power
        at = found.end()
    return Unit(scale, {d: p for d, p in dims.items() if p})


def conversion(source: str, target: str, density: float = WATER_DENSITY, molar_mass: float = CARBON_MOLAR_MASS) -> tuple[float, float]:
    """(scale, offset) with target = source * scale + offset; bridges m <-> kg m-2 of water and mol <-> g of carbon."""
    a, b = parse(source), parse(target)
    bridge = 1.0
    if a.dims != b.dims:
        gap = {d: b.dims.get(d, 0) - a.dims.get(d, 0) for d in {*a.dims, *b.dims} if b.dims.get(d, 0) != a.dims.get(d, 0)}
        if gap == {"kg": 1, "m": -3}:
            bridge = density
        elif gap == {"kg": -1, "m": 3}:
            bridge = 1 / density
        elif gap == {"kg": 1, "mol": -1}:
            bridge = molar_mass * 1e-3
        elif gap == {"kg": -1, "mol": 1}:
            bridge = 1 / (molar_mass * 1e-3)
        else:
            raise UnitConversionError(f"{source!r} to {target!r}")
    return a.scale * bridge / b.scale, (a.offset * bridge - b.offset) / b.scale


def tidy(text: str) -> str:
    """Names of the unit 1 become 1; a C or N after a mass is taken off."""
    text = text.strip()
    if text.lower() in PLAIN:
        return "1"
    return re.sub(r"\b(k?g|[PTGMmu]g)\s?(?:C|N)\b", r"\1", text)


def multiply(a: str, b: str) -> str:
    return " ".join(x for x in (a, b) if x != "1") or "1"


def inverse(text: str) -> str:
    return "1" if text == "1" else " ".join(re.sub(r"^([A-Za-z%]+)(-?\d+)?$", lambda m: f"{m[1]}{-int(m[2] or 1)}", x) for x in text.split())
