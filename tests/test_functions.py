import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.functions import geometry as G
from pointlake.functions import jsonx as J
from pointlake.functions import parsers as PR
from pointlake.functions import raster as RA
from pointlake.functions import rng as RNG
from pointlake.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    df = spark.range(1)

    def value(column):
        return df.select(column.alias("v")).first()["v"]

    return value


@pytest.mark.parametrize(("a", "b", "want"), [(0.0, 350.0, 10.0), (355.0, 5.0, 10.0), (10.0, 10.0, 0.0), (0.0, 180.0, 180.0)])
def test_angle_delta(one, a, b, want):
    assert one(G.angle_delta(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize(("t", "want"), [((10.0, 0.0), "right"), ((0.0, 10.0), "down"), ((-10.0, -10.0), "up-left"), ((1.0, -1.0), "up-right")])
def test_compass(one, t, want):
    assert one(G.nearest_direction(F.lit(0.0), F.lit(0.0), F.lit(t[0]), F.lit(t[1]))) == want


def test_bearing_matches_python(one):
    for x, y in ((3.0, 4.0), (-3.0, 4.0), (-3.0, -4.0), (0.5, -9.0)):
        assert one(G.bearing(F.lit(0.0), F.lit(0.0), F.lit(x), F.lit(y))) == pytest.approx((math.degrees(math.atan2(y, x)) + 360) % 360)


def test_spaces(one):
    lit = F.lit
    p = one(G.guess_to_pixel(lit(0.5), lit(0.5), lit(101), lit(51)))
    assert (p["x"], p["y"]) == (50.5, 25.5)
    p = one(G.guess_to_pixel(lit(50.0), lit(10.0), lit(640), lit(480)))
    assert (p["x"], p["y"]) == (320.0, 48.0)
    assert one(G.norm_to_pixel(lit(0.5), lit(101))) == 50.0 and one(G.norm_to_pixel(lit(0.75), lit(200))) == pytest.approx(149.25)
    assert one(G.guess_to_norm(lit(5.0), lit(5.0), lit(0), lit(9))) is None
    assert one(G.clip_pixel_rounded(lit(2.5), lit(10))) == 2 and one(G.clip_pixel_rounded(lit(99.0), lit(10))) == 9


def test_target_texts(one):
    pts = lambda *ps: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ps])
    assert one(X.point_text(pts((0.1234, 0.5678)))) == "<point>123,568</point>"
    assert one(X.point_text(pts((0.1, 0.2), (0.3, 0.4)), multi=True)) == "<points>100,200; 300,400</points>"
    assert one(X.point_text(F.array().cast("array<struct<x:double,y:double>>"))) == "<point>500,500</point>"
    assert one(X.fixed_tokens(pts((0.475, 0.612), (0.632, 0.069)))) == "2 POS_0475 POS_0612 POS_0632 POS_0069"
    assert one(X.fixed_tokens(pts((32.0, 16.0)), F.lit(64), F.lit(64))) == "1 POS_0500 POS_0250"
    assert [(p["x"], p["y"]) for p in one(X.fixed_tokens_decode(F.lit("2 POS_0475 POS_0612 POS_0632 POS_0069")))] == [(475, 612), (632, 69)]
    args = (pts((50.0, 10.0), (20.0, 30.0)), F.lit(100), F.lit(100), F.lit(" cups "))
    assert one(X.coords_tag(*args, F.lit("point_count"))) == 'Counting the <points coords="1 1 200 300 2 500 100">cups</points> shows a total of 2.'
    assert one(X.coords_tag(F.array().cast("array<struct<x:double,y:double>>"), *args[1:], F.lit("count"))) == "There are none."


@pytest.mark.parametrize(("said", "want"), [("Spatial", "Spatial Relation"), ("object_reference", "Object Reference"), (" COUNTING ", "Counting"), ("none", None), (None, None), ("steerable", None)])
def test_category(one, said, want):
    assert one(X.category(F.lit(said).cast("string"))) == want


def test_strings(one):
    lit = F.lit
    assert one(X.query_key(lit(" Point to the Cup. "))) == "point to the cup"
    assert one(X.strip(lit("  a b　\n"))) == "a b"
    assert one(X.short_text(lit('```json\n "a  b"\n```'))) == "a b"
    assert one(X.head_noun(lit("the Red_Cup"))) == "cup" and one(X.class_key(lit("The  red/cup"))) == "red cup"
    assert one(X.file_name(lit(" ../a b?c.json "))) == "a_b_c.json" and one(X.file_name(lit("???"))) == "object"
    assert one(X.stem(lit("/a/b.c/d.tar.gz"))) == "d.tar" and one(X.stem(lit(".hidden"))) == ".hidden"
    assert one(X.key_of_value(lit("x/abc.png"))) == "abc" and one(X.key_of_value(lit("abc"))) == "abc"
    assert [one(X.cleaning_method(lit(x))) for x in ("sam_clean_mix10000_v2", "local_three_types_2000_each", "mix4_pointsabs_len1_10000_rule_llm", "")] == ["sam_clean", "clean_3types_local", "benchmark_extract", "unknown"]
    assert one(X.csv_list(lit(" a, ,b"))) == ["a", "b"] and one(X.endpoint(lit("http://x/v1//"))) == "http://x/v1"
    assert one(X.keeps_cues(lit("Object Reference"), lit("the cursor"), lit("the cup"))) is False
    assert one(X.prefilter(lit("something used to cut all"), "Affordance")) is False and one(X.prefilter(lit("it might fall"), "Reasoning")) is True
    seed = one(X.stable_seed(lit('{"parts": ["a"], "seed": 1}')))
    import hashlib

    assert int(seed) == int.from_bytes(hashlib.sha256(b'{"parts": ["a"], "seed": 1}').digest()[:8], "big")


def test_times(one):
    fall = F.lit("2000-01-01").cast("timestamp")
    show = lambda t: one(J.timestamp_iso(F.lit(t).cast("string"), fall))
    assert show("2024-03-20T10:00:00Z") == "2024-03-20T10:00:00Z" and show("2024-03-20T10:00:00.25+02:00") == "2024-03-20T08:00:00.250000Z"
    assert show("never") == show(None) == "2000-01-01T00:00:00Z"


def test_outputs(one):
    c = one(J.cleaning_output(F.lit('ok ```{"keep": "yes", "core_target": " cup ", "reason": "r"}``` ')))
    assert (c["keep"], c["core_target"], c["reason"]) == (True, "cup", "r")
    assert one(J.cleaning_output(F.lit('{"keep": true, "core_target": "", "reason": "r"}'))) is None
    assert one(J.multipoint_output(F.lit('{"multi_point": 1, "reason": "r"}'))) is None
    assert one(J.multipoint_output(F.lit('{"multi_point": false, "reason": "r"}')))["multi_point"] is False


@pytest.mark.parametrize(("text", "w", "h", "want"), [
    ("<point>120,340</point>", 100, 100, [(12, 34)]), ("<point>0.127,0.342</point>", 100, 100, [(13, 34)]), ("<point>9999,-10</point>", 20, 30, [(19, 0)]), ("<points>100,200; 300,400</points>", 101, 101, [(10, 20), (30, 40)]),
    ('<points coords="1 1 300 798">hand</points>', 1001, 1001, [(300, 798)]), ('<tracks coords="0.0 1 300 798;1.0 1 5 6"/>', 1001, 1001, [(300, 798), (5, 6)]), ("at 10, 20 and 5000,1", 1001, 1001, [(10, 20)]), ("none", 9, 9, []),
])
def test_parser(text, w, h, want):
    assert PR.points_in(text, w, h) == want


def test_parser_limits():
    loose = " ".join(f"{k},{k}" for k in range(40))
    assert len(PR.points_in(loose, 1001, 1001)) == 16 and PR.points_in(loose, 1001, 1001, 3) == [(0, 0), (1, 1), (2, 2)]
    assert PR.points_alone(' <points coords="1 1 300 798"> </points>\n', 1001, 1001) == [(300, 798)] == PR.points_alone('<points coords="1 1 300 798"/>', 1001, 1001)
    assert PR.points_alone('x <points coords="1 1 300 798"></points>', 1001, 1001) == []


@pytest.mark.parametrize(("text", "w", "h", "want"), [("(0.208,0.233)", 1000, 1000, "(208, 233)"), ("[20, 35]", 1280, 720, "[200, 350]"), ("(2000, -15)", 1000, 500, "(1000, 0)")])
def test_tuples(text, w, h, want):
    assert PR.rewrite_tuples(text, w, h) == want


def test_segments():
    text = 'Counting the <points coords="1 1 274 684 2 288 550">all Book</points> shows a total of 2.'
    got = lambda b: "".join(text[s:e] for n, s, e in PR.segments(text) if n == b)
    assert (got("anchor_digits"), got("point_index_digits"), got("coord_x_digits_all"), got("coord_y_digits_all")) == ("11", "2", "274288", "684550")
    assert (got("coord_x_hundreds"), got("coord_y_tens"), got("coord_y_ones"), got("label_text")) == ("22", "85", "40", "all Book")


def test_rasters():
    rng = np.random.default_rng(0)
    m = rng.random((30, 40)) > 0.6
    assert np.array_equal(RA.unpack(RA.pack(m)), m)
    assert RA.components(np.zeros((3, 3), bool)) == 0

    def flood(mask):
        todo, n = mask.copy(), 0
        while todo.any():
            n += 1
            stack = [tuple(np.argwhere(todo)[0])]
            while stack:
                y, x = stack.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and todo[y, x]:
                    todo[y, x] = False
                    stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        return n

    for density in (0.2, 0.5, 0.8):
        m = rng.random((20, 25)) < density
        assert RA.components(m) == flood(m)
    dot = np.zeros((11, 11), bool)
    dot[5, 5] = True
    y, x = np.mgrid[:11, :11]
    assert np.array_equal(RA.dilate(dot, 3), (x - 5) ** 2 + (y - 5) ** 2 <= 9)
    assert RA.line((5, 9), [(0, 2), (8, 2)], 1)[2].all() and RA.components(RA.line((50, 50), [(1, 1), (40, 30)], 2)) == 1
    assert RA.medoid(dot) == (5, 5) and RA.medoid(np.zeros((2, 2), bool)) is None
    assert RA.coverage(dot, [{"x": 5.2, "y": 4.8}, {"x": 99, "y": 0}]) == 0.5


def png(grey: np.ndarray, filters) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows, above = b"", np.zeros(grey.shape[1], int)
    for row, f in zip(grey.astype(int), filters):
        left = np.concatenate([[0], row[:-1]])
        corner = np.concatenate([[0], above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows += bytes([f]) + ((row - [0, left, above, (left + above) // 2, paeth][f]) % 256).astype(np.uint8).tobytes()
        above = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    grey = np.random.default_rng(1).integers(0, 256, (10, 7)).astype(np.uint8)
    data = png(grey, [0, 1, 2, 3, 4] * 2)
    assert RA.image_size(data) == (7, 10) and np.array_equal(RA.decode_png(data), grey)
    assert RA.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x40\x03" + b"\0" * 9) == (64, 32)
    assert RA.image_size(b"GIF89a\x05\x00\x06\x00") == (5, 6) and RA.image_size(b"nope") == (0, 0) and RA.decode_png(b"x") is None
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(b"hello")
    from pointlake.sources import scans

    got = {r["path"].rsplit("/", 1)[-1]: (r["width"], r["height"], r["ok"]) for r in scans.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (7, 10, True), "b.txt": (0, 0, False)}
    mask = scans.masks(spark, str(tmp_path / "a.png")).first()["mask"]
    assert np.array_equal(RA.unpack(mask.asDict()), grey > 0)


def test_seeded_draws(spark):
    row = spark.range(1).select(RNG.sample_order(F.lit(3), F.lit("k"), F.lit(5)).alias("o"), RNG.sorted_sample(F.lit("id"), F.lit(10), F.lit(3)).alias("s")).first()
    want = list(range(5))
    RNG.seeded(3, "order", "k").shuffle(want)
    assert row["o"] == want and row["s"] == sorted(random.Random("id").sample(range(10), 3))


def test_coordinate_map(spark):
    pts = F.array(F.struct(F.lit(500.0).alias("x"), F.lit(250.0).alias("y")))
    layers = np.array(spark.range(1).select(RA.coordinate_map(pts, F.lit(41)).alias("m")).first()["m"])
    assert layers.shape == (4, 41, 41) and np.unravel_index(layers[0].argmax(), (41, 41)) == (10, 20) and layers[0].max() == pytest.approx(1.0)
