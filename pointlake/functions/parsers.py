"""Points in model outputs, and texts taken apart by the character: pandas UDFs.

The regular expressions nest (a list of pairs inside a tag), which no built-in function expresses
with the order and de-duplication over all forms that results need.
"""

from __future__ import annotations

import re

import pandas as pd
from .udfs import vectorised

# --- fixed values: the tags that outputs may hold ---
_NUMBER = r"[+-]?\d+(?:\.\d+)?"
_PAIR = re.compile(rf"({_NUMBER})\s*,\s*({_NUMBER})")
_ONE = re.compile(rf"<point>\s*({_NUMBER})\s*,\s*({_NUMBER})\s*</point>", re.I)
_MANY = re.compile(r"<points>\s*(.*?)\s*</points>", re.I | re.S)
_COORDS = re.compile(r'<(?:points|tracks)\b[^>]*\bcoords="([0-9\t:;, .]+)"[^>]*>', re.I)
_FRAME = re.compile(r"(?:^|[\t:;,])([0-9]+(?:\.[0-9]+)?)\s+([0-9.\s]+)")
_TRIPLE = re.compile(r"([0-9]{1,3})\s+([0-9]{1,4}(?:\.[0-9]+)?)\s+([0-9]{1,4}(?:\.[0-9]+)?)")
_ALONE = re.compile(r'\s*<points\b[^>]*\bcoords="([0-9\t:;, .]+)"[^>]*(?:>\s*</points>|/>)\s*', re.I | re.S)
_TUPLE = re.compile(rf"([(\[])\s*({_NUMBER})\s*,\s*({_NUMBER})\s*([)\]])")
_MOST_LOOSE = 16


def pixel(x: float, y: float, w: int, h: int, absolute: bool) -> tuple[int, int] | None:
    fraction = any(abs(v - round(v)) >= 1e-6 for v in (x, y))
    if 0 <= x <= 1 and 0 <= y <= 1 and fraction:
        scale = 1.0
    elif 0 <= x <= 1000 and 0 <= y <= 1000:
        scale = 1000.0
    elif absolute:
        scale = None
    else:
        return None
    if scale:
        x, y = x / scale * max(w - 1, 1), y / scale * max(h - 1, 1)
    return min(max(round(x), 0), max(w - 1, 0)), min(max(round(y), 0), max(h - 1, 0))


def _triples(block: str):
    bodies = [m[2] for m in _FRAME.finditer(block)] or [block]
    for body in bodies:
        for m in _TRIPLE.finditer(body):
            yield float(m[2]), float(m[3])


def _pairs(text: str):
    """(x, y, whether pixels are allowed) of all tags in the order of their forms."""
    for m in _COORDS.finditer(text):
        yield from ((x, y, False) for x, y in _triples(m[1]))
    for m in _MANY.finditer(text):
        yield from ((float(p[1]), float(p[2]), True) for p in _PAIR.finditer(m[1]))
    yield from ((float(m[1]), float(m[2]), True) for m in _ONE.finditer(text))


def points_in(text: str | None, w: int, h: int, most: int | None = None) -> list[tuple[int, int]]:
    """Distinct pixels in order. Loose pairs count only where there is no tag, and only 16 of them."""
    found: dict[tuple[int, int], None] = {}

    def take(pairs, limit):
        for x, y, absolute in pairs:
            p = pixel(x, y, w, h, absolute)
            if p is not None:
                found.setdefault(p)
            if limit is not None and len(found) >= limit:
                return

    take(_pairs(text or ""), most)
    if not found:
        loose = ((float(m[1]), float(m[2]), False) for m in _PAIR.finditer(text or ""))
        take(loose, _MOST_LOOSE if most is None else min(most, _MOST_LOOSE))
    return list(found)


def points_alone(text: str | None, w: int, h: int) -> list[tuple[int, int]]:
    """Of an output that is one empty tag and nothing else."""
    m = _ALONE.fullmatch(text or "")
    return list(dict.fromkeys(filter(None, (pixel(x, y, w, h, False) for x, y in _triples(m[1]))))) if m else []


_POINTS = "array<struct<x:int,y:int>>"


def _series(found) -> pd.Series:
    return pd.Series([[{"x": x, "y": y} for x, y in ps] for ps in found])


@vectorised(_POINTS)
def parse_points(text: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return _series(points_in(t, int(a), int(b)) for t, a, b in zip(text, w, h))


@vectorised(_POINTS)
def parse_points_strict(text: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return _series(points_alone(t, int(a), int(b)) for t, a, b in zip(text, w, h))


def rewrite_tuples(text: str | None, w: int, h: int) -> str:
    """Coordinate pairs in brackets as whole numbers on [0, 1000]."""

    def put(m: re.Match) -> str:
        x, y = float(m[2]), float(m[3])
        if 0 <= x <= 1 and 0 <= y <= 1:
            a, b = x, y
        elif 0 <= x <= 100 and 0 <= y <= 100 and (w > 100 or h > 100):
            a, b = x / 100, y / 100
        elif 0 <= x <= 1000 and 0 <= y <= 1000:
            a, b = x / 1000, y / 1000
        else:
            a, b = x / max(w - 1, 1), y / max(h - 1, 1)
        return f"{m[1]}{round(1000 * min(max(a, 0.0), 1.0))}, {round(1000 * min(max(b, 0.0), 1.0))}{m[4]}"

    return _TUPLE.sub(put, text or "")


@vectorised("string")
def normalise_tuples(text: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series([rewrite_tuples(t, int(a), int(b)) for t, a, b in zip(text, w, h)])


def segments(text: str | None) -> list[tuple[str, int, int]]:
    """(bucket, start, end) of a target text: the digits of points by axis and place, the label, the
    fixed parts of the tag, and what stands around it. Ends are exclusive."""
    out: list[tuple[str, int, int]] = []
    t, at = text or "", 0
    for m in re.finditer(r'<points coords="([^"]*)">(.*?)</points>', t, re.S):
        if m.start() > at:
            out.append(("other_target_text", at, m.start()))
        at = m.end()
        numbers = list(re.finditer(r"\d+", m[1]))
        base, fixed = m.start(1), m.start()
        for k, d in enumerate(numbers):
            a, b = base + d.start(), base + d.end()
            if k < 2:
                out.append(("anchor_digits", a, b))
            elif (k - 1) % 3 == 0:
                out.append(("point_index_digits", a, b))
            else:
                axis = "x" if (k - 1) % 3 == 1 else "y"
                if a > fixed:
                    out.append(("fixed_field", fixed, a))
                fixed = b
                out += [("coord_digits_all", a, b), (f"coord_{axis}_digits_all", a, b)]
                for place, i in zip(("ones", "tens", "hundreds"), range(b - 1, a - 1, -1)):
                    out += [(f"coord_{place}", i, i + 1), (f"coord_{axis}_{place}", i, i + 1)]
        out.append(("fixed_field", fixed, m.start(2)))
        if m[2]:
            out.append(("label_text", m.start(2), m.end(2)))
        out.append(("fixed_field", m.end(2), m.end()))
    if at < len(t):
        out.append(("other_target_text", at, len(t)))
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


@vectorised("array<struct<bucket:string,start:int,end:int>>")
def segment_text(text: pd.Series) -> pd.Series:
    return pd.Series([[{"bucket": b, "start": s, "end": e} for b, s, e in segments(t)] for t in text])
