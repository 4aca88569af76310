from __future__ import annotations

import random

from pointlake.llm import pii

from . import brute

PLUS = ["+10.0.0.1", "dns+8.8.8.8", "3+1.2.3.4", "+192.168.1.10", "++1.2.3.4", "1.2+3.4.5.6", "a=1+(1.2.3.4)+b", "q=+1.1.1.1+2.2.2.2", "3+1.2.3.4 x +1 555 010 2000", "+1.2.3.400", "+1.2.3.4+", "é+1.2.3.4"]


def test_ip_after_plus(spark):
    r = random.Random(3)
    texts = PLUS + ["".join(r.choice(("1.2.3.4", "+", "+", "7", ".", " ", "(", "-", "x", "10.0.0.1", "@")) for _ in range(r.randint(2, 9))) for _ in range(1500)]
    found = pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    for row in found.collect():
        want = sorted((k, *s) for k, name in enumerate(pii.KINDS) for s in brute.base_spans(row["text"])[name])
        assert [(p["kind"], p["s"], p["e"]) for p in row["pii"] if p["base"]] == want, row["text"]


def test_redacts_ip_after_plus(spark):
    df = pii.pii_spans(spark.createDataFrame([("dns+8.8.8.8 ok",)], "text string"))
    assert df.select(pii.redact(df["text"], df["pii"])).first()[0] == "dns+[ip] ok"
