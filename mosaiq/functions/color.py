"""Colours as Columns: hex, CIELAB, colour difference, hue families."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sRGB and CIELAB definitions: matrix rows for X, Y and Z, and the D65 white.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
# The families with their labels and swatches, in display order.
FAMILIES = (
    ("red", "Red", "#e02424"), ("orange", "Orange", "#f97316"), ("yellow", "Yellow", "#eab308"), ("green", "Green", "#22a355"),
    ("cyan", "Cyan", "#06b6d4"), ("blue", "Blue", "#2563eb"), ("purple", "Purple", "#7c3aed"), ("pink", "Pink", "#db2777"),
    ("neutral", "Neutral", "#71717a"),
)
# The hue at which each family ends; from 345 it is red again.
HUES = (("red", 15), ("orange", 45), ("yellow", 70), ("green", 165), ("cyan", 195), ("blue", 255), ("purple", 290), ("pink", 345))
WHEEL = tuple(name for name, _ in HUES)


class Rgb(NamedTuple):
    r: Column
    g: Column
    b: Column


def rgb(r: Column | str | float, g: Column | str | float, b: Column | str | float) -> Rgb:
    return Rgb(*(F.col(c) if isinstance(c, str) else F.lit(c) for c in (r, g, b)))


def to_hex(c: Rgb) -> Column:
    """#rrggbb, channels rounded half up and held within 0 and 255."""
    two = lambda x: F.lpad(F.lower(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), *(two(x) for x in c))


def from_hex(text: Column | str) -> Rgb:
    """The channels of #rgb or #rrggbb, with or without the sign, in any case; nulls for anything else."""
    text = F.col(text) if isinstance(text, str) else text
    digits = F.lower(F.regexp_replace(F.trim(text), "^#", ""))
    full = F.when(digits.rlike(r"^[0-9a-f]{6}\z"), digits).when(digits.rlike(r"^[0-9a-f]{3}\z"), F.regexp_replace(digits, "(.)", "$1$1"))
    return Rgb(*(F.conv(F.substring(full, i, 2), 16, 10).cast("int") for i in (1, 3, 5)))


def linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


class Lab(NamedTuple):
    l: Column  # noqa: E741
    a: Column
    b: Column


def to_lab(c: Rgb) -> Lab:
    parts = [linear(x) for x in c]
    curve = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = (row[0] * parts[0] + row[1] * parts[1] + row[2] * parts[2]) / white
        curve.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise(24389 / 27 * t / 116 + 4 / 29))
    fx, fy, fz = curve
    return Lab(116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz))


def lab_of(r: float, g: float, b: float) -> tuple[float, float, float]:
    """to_lab of one colour, for literals."""
    part = [x / 255 / 12.92 if x / 255 <= 0.04045 else ((x / 255 + 0.055) / 1.055) ** 2.4 for x in (r, g, b)]
    t = [sum(k * p for k, p in zip(row, part, strict=True)) / white for row, white in zip(TO_XYZ, WHITE, strict=True)]
    fx, fy, fz = (math.cbrt(x) if x > 216 / 24389 else 24389 / 27 * x / 116 + 4 / 29 for x in t)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def delta_e(a: Lab, b: Lab) -> Column:
    """The CIE76 difference."""
    return F.sqrt(F.pow(a.l - b.l, F.lit(2.0)) + F.pow(a.a - b.a, F.lit(2.0)) + F.pow(a.b - b.b, F.lit(2.0)))


def luminance(c: Rgb) -> Column:
    return 0.2126 * linear(c.r) + 0.7152 * linear(c.g) + 0.0722 * linear(c.b)


def readable_on(c: Rgb) -> Column:
    return F.when(luminance(c) > 0.179, "#000000").otherwise("#ffffff")


class Hsv(NamedTuple):
    h: Column
    s: Column
    v: Column


def to_hsv(c: Rgb) -> Hsv:
    """Hue in degrees, saturation and value in 0..1; of equal channels red counts as the largest, then green."""
    r, g, b = (x / 255.0 for x in c)
    top = F.greatest(r, g, b)
    span = top - F.least(r, g, b)
    sixth = F.when(top == r, F.try_divide(g - b, span)).when(top == g, F.try_divide(b - r, span) + 2).otherwise(F.try_divide(r - g, span) + 4)
    return Hsv(F.pmod(F.coalesce(sixth, F.lit(0.0)) * 60, F.lit(360.0)), F.coalesce(F.try_divide(span, top), F.lit(0.0)), top)


def family(c: Rgb) -> Column:
    """The hue family. The hue is computed once, as the element of an array, not for each comparison."""
    hsv = to_hsv(c)

    def named(hue: Column) -> Column:
        out = F.lit("red")
        for name, end in reversed(HUES):
            out = F.when(hue < end, name).otherwise(out)
        return out

    return F.when((hsv.s < 0.15) | (hsv.v < 0.12), "neutral").otherwise(F.element_at(F.transform(F.array(hsv.h), named), 1))


def family_of(r: int, g: int, b: int) -> str:
    """family of one colour, for literals."""
    top, low = max(r, g, b), min(r, g, b)
    if top == 0 or (top - low) / top < 0.15 or top / 255 < 0.12:
        return "neutral"
    span = top - low
    hue = 60 * (math.fmod((g - b) / span, 6) if top == r else (b - r) / span + 2 if top == g else (r - g) / span + 4)
    hue += 360 * (hue < 0)
    return next((name for name, end in HUES if hue < end), "red")


def families_near(r: int, g: int, b: int) -> list[str] | None:
    """The colour's family, its two neighbours on the wheel and neutral; None (no filter) for a neutral colour."""
    own = family_of(r, g, b)
    if own == "neutral":
        return None
    i = WHEEL.index(own)
    return [WHEEL[i - 1], own, WHEEL[(i + 1) % len(WHEEL)], "neutral"]
