"""Columns of the input that are named like an operator's own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointlake.llm import ann, line_dedup, lm_score, mixing, near_dup, packing, pii, quality, queries, sharding, simhash, warc

from .test_llm import DOCS, EDGE

#: Names that the operators use within or give to their results.
NAMES = {
    "line_dedup": ["n_lines", "N_DROPPED", "i", "th", "gone", "lines", "line", "pos", "key", "h1", "least", "ld_in_0", "ld_total", "ld_gone"],
    "pii": ["pii", "PII_RAW", "pii_more", "pii_in_0"],
    "quality": ["q_kept", "Q_N_WORDS", "q_base_failed", "q_words", "g_lang", "f_source", "hi_symbols", "qi_0", "qi_in_0", "qi_text", "bucket", "measure"],
    "mixing": ["mix_size", "MIX_COPIES", "mix_target", "mix_source_size", "rate", "source_null", "source_name", "source_size", "target", "mi_0", "mi_in_0", "mi_id", "mi_copy"],
    "sharding": ["sh_size", "SH_SHARD", "sh_slot", "sh_crc32", "sh_id", "sh_rank", "sh_at", "sh_one", "sh_out_0", "sh_in_0", "rk_at", "rk_n"],
    "simhash": ["fp", "NODE", "least", "si_row", "si_id", "si_0", "root"],
    "near_dup": ["node", "N", "bands", "key", "nd_row", "nd_id", "nd_0", "root", "set"],
    "stages": ["n_lines", "N_DROPPED", "q_kept", "Q_N_WORDS", "mix_size", "c_0", "fp", "node", "bands"],
    "other": ["word", "lm_id", "LM_TEXT", "held_out", "score", "start", "ids", "sequence_id", "id", "url", "payload", "digest", "size", "at", "cell", "v", "asks", "block", "w_0"],
}


@pytest.fixture(scope="module")
def clash(spark):
    edge = spark.createDataFrame(EDGE, DOCS)
    return lambda kind: edge.select("*", *[F.concat(F.lit(n), F.lit("!")).alias(n) for n in NAMES[kind]])


def kept(out, kind):
    """The input's columns stay, first and under their names, with their values."""
    width = len(DOCS.split(",")) + len(NAMES[kind])
    assert out.columns[5:width] == NAMES[kind]
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        assert list(r[5:width]) == [f"{n}!" for n in NAMES[kind]]
    return rows


def test_operators(clash):
    rows = kept(line_dedup.line_dedup(clash("line_dedup")), "line_dedup")
    assert {r["_n_lines"] for r in rows if r["doc_id"] == 4} == {1} and sum(r["_n_dropped"] for r in rows) == 3
    assert any(r["_pii"] for r in kept(pii.pii_spans(clash("pii")), "pii"))
    assert any(r["_q_kept"] for r in kept(quality.quality_verdicts(clash("quality")), "quality"))
    assert all(r["_mix_copies"] is not None for r in kept(mixing.mix_plan(clash("mixing")), "mixing"))
    kept(mixing.mix(clash("mixing")), "mixing")
    names = clash("sharding").columns
    assert {r["_sh_shard"] for r in kept(sharding.shard_plan(clash("sharding"), 3, carry=names), "sharding")} == {0, 1, 2}
    kept(simhash.simhash_dedup(clash("simhash")), "simhash")
    kept(near_dup.near_dedup(clash("near_dup")), "near_dup")


def test_operators_that_carry_nothing(spark, clash, tmp_path):
    df = clash("other")
    assert lm_score.lm_score(df, queries._vocabulary("piece_bpe_32k.model")).count() == len(EDGE)
    assert packing.pack(df, queries._vocabulary("byte_bpe_50k.json")).count() >= len(EDGE)
    pages = df.withColumnsRenamed({"doc_id": "page_id", "text": "html"})
    assert warc.write_warc(pages, f"file://{tmp_path}/w").agg(F.sum("records")).first()[0] == len(EDGE)
    vectors = df.drop("text").withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double")))
    assert ann.search(vectors, F.col("doc_id") == 2, id_col="doc_id").count() > 0


def test_stages(spark, sf, clash):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept(stage(spark, clash("stages"), sf), "stages")
    assert corpus_pipeline.packed(spark, clash("stages"), sf).count() >= len(EDGE)
