"""Draws that must equal those of Python's seeded generators: pandas UDFs, one generator for each row."""

from __future__ import annotations

import hashlib
import json
import math
import random

import numpy as np
import pandas as pd
from .udfs import vectorised


def seeded(seed: int, *parts) -> random.Random:
    """A generator from the first 8 bytes of SHA-256 of the canonical JSON of its parts."""
    text = json.dumps({"seed": seed, "parts": list(parts)}, ensure_ascii=False, sort_keys=True, default=str)
    return random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))


def draw_anchor(rng: random.Random, target, angle: float, w: float, h: float, tries: int = 30, jitter: float = 10.0, border: float = 8.0):
    """A place from which the target lies about in the direction: (x, y, angle, radius), or None if
    all tries fall outside the border."""
    side = min(w, h)
    for _ in range(tries):
        a = angle + rng.uniform(-jitter, jitter)
        r = rng.uniform(max(45.0, side * 0.08), max(45.0, side * 0.28))
        x, y = target[0] - math.cos(math.radians(a)) * r, target[1] - math.sin(math.radians(a)) * r
        if border <= x <= w - border and border <= y <= h - border:
            return x, y, a % 360.0, r
    return None


@vectorised("struct<x:double,y:double,angle:double,radius:double>")
def anchor(seed: pd.Series, image: pd.Series, ident: pd.Series, direction: pd.Series, x: pd.Series, y: pd.Series, angle: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    rows = [draw_anchor(seeded(int(s), "move_until", i, o, d), (a, b), t, ww, hh) or (None,) * 4 for s, i, o, d, a, b, t, ww, hh in zip(seed, image, ident, direction, x, y, angle, w, h)]
    return pd.DataFrame(rows, columns=["x", "y", "angle", "radius"], dtype=float)


@vectorised("array<int>")
def sample_order(seed: pd.Series, key: pd.Series, n: pd.Series) -> pd.Series:
    """A shuffle of 0 .. n - 1."""
    out = []
    for s, k, m in zip(seed, key, n):
        order = list(range(int(m)))
        seeded(int(s), "order", k).shuffle(order)
        out.append(order)
    return pd.Series(out)


@vectorised("array<int>")
def sorted_sample(key: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    """k of n indices, ascending; all of them if there are no more. The key is the seed."""
    return pd.Series([sorted(random.Random(s).sample(range(int(m)), int(q))) if int(m) > int(q) else list(range(int(m))) for s, m, q in zip(key, n, k)])


@vectorised("array<struct<x:double,y:double>>")
def mask_sample(mask: pd.DataFrame, key: pd.Series, k: pd.Series) -> pd.Series:
    """k pixels of a mask; with repeats only where it has fewer."""
    from .raster import unpack

    out = []
    for m, s, q in zip(mask.to_dict("records"), key, k):
        y, x = np.nonzero(unpack(m))
        rng = random.Random(str(s))
        if not len(x) or int(q) <= 0:
            out.append([])
            continue
        at = rng.sample(range(len(x)), int(q)) if len(x) >= int(q) else [rng.randrange(len(x)) for _ in range(int(q))]
        out.append([{"x": float(x[i]), "y": float(y[i])} for i in at])
    return pd.Series(out)


@vectorised("struct<corrected:boolean,points:array<struct<x:double,y:double>>>")
def perturb(key: pd.Series, points: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
    """With probability 1/2 noisy points: each moved by a normal of 100, of several each dropped with
    0.15 and one inserted with 0.15; never none. The seed is a stable hash of the key."""
    flags, out = [], []
    for k, ps, ww, hh in zip(key, points, w, h):
        rng = np.random.RandomState(int.from_bytes(hashlib.sha256(str(k).encode()).digest()[:4], "big") % 2**31)
        ps = [(p["x"], p["y"]) for p in ps]
        if rng.random_sample() >= 0.5 or not ps:
            flags.append(False)
            out.append([{"x": x, "y": y} for x, y in ps])
            continue
        moved = []
        for x, y in ps:
            if len(ps) > 1 and rng.random_sample() < 0.15:
                continue
            a, b = x + rng.normal(0, 100.0), y + rng.normal(0, 100.0)
            moved.append((round(min(max(a, 0.0), float(ww)), 1), round(min(max(b, 0.0), float(hh)), 1)))
        if len(ps) > 1 and rng.random_sample() < 0.15:
            moved.append((round(rng.uniform(0, float(ww)), 1), round(rng.uniform(0, float(hh)), 1)))
        flags.append(True)
        out.append([{"x": float(x), "y": float(y)} for x, y in (moved or ps[:1])])
    return pd.DataFrame({"corrected": flags, "points": out})
