"""Column functions against plain Python on generated texts, many texts in each query."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointlake.functions import geometry as G
from pointlake.functions import jsonx as J
from pointlake.functions import text as X

RULES = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
SOME = st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0　 .\"'`_-/aAéßzZ09<>{}"), st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=30), min_size=30, max_size=120)


def column(spark, texts, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, t {kind}").select("i", f(F.col("t")).alias("v")).collect()
    return [v for _, v in sorted(rows)]


@RULES
@given(SOME)
def test_strip_and_collapse(spark, texts):
    assert column(spark, texts, X.strip) == [t.strip() for t in texts]
    assert column(spark, texts, X.collapse) == [re.sub(r"\s+", " ", t).strip() for t in texts]


@RULES
@given(SOME)
def test_file_names(spark, texts):
    want = [(re.sub(r"[^A-Za-z0-9_.-]+", "_", t.strip())[:90].strip("._") or "object") for t in texts]
    assert column(spark, texts, X.file_name) == want


@RULES
@given(SOME)
def test_fences(spark, texts):
    fenced = [*texts, *(f"```JSON\n{t}\n```" for t in texts)]

    def plain(t):
        t = t.strip()
        if t.startswith("```"):
            t = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", t, flags=re.I))
        return t.strip()

    assert column(spark, fenced, X.strip_fence) == [plain(t) for t in fenced]


@RULES
@given(st.lists(st.dictionaries(st.sampled_from(["keep", "reason", "text", "n"]), st.one_of(st.booleans(), st.integers(-9, 9), st.sampled_from(["yes", "no", "x", " Keep "]), st.none()), max_size=4), min_size=20, max_size=60))
def test_lenient_objects(spark, docs):
    texts = [f"so: {json.dumps(d)} ok" if k % 2 else json.dumps(d) for k, d in enumerate(docs)]
    said = {"true": True, "yes": True, "1": True, "keep": True, "false": False, "no": False, "0": False, "drop": False}
    keep = lambda v: v if isinstance(v, bool) else said.get(v.strip().lower()) if isinstance(v, str) else None
    got = column(spark, texts, lambda t: J.boolish(F.try_variant_get(J.lenient_object(t), "$.keep", "variant")))
    assert got == [keep(d.get("keep")) for d in docs]


@RULES
@given(st.lists(st.tuples(st.floats(-720, 720), st.floats(-720, 720)), min_size=20, max_size=80))
def test_angles(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "i int, a double, b double").select("i", G.angle_delta(F.col("a"), F.col("b")).alias("v"))
    for (_, v), (a, b) in zip(sorted(df.collect()), pairs):
        d = abs(a - b) % 360
        assert abs(v - min(d, 360 - d)) < 1e-5
