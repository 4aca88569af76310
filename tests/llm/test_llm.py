from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

import corpus_pipeline
from pointlake.llm import ann, common, line_dedup, lm_score, mixing, packing, pii, quality, queries, sharding, simhash, warc
from pointlake.llm.sql import SQL

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("alpha beta gamma delta epsilon zeta\n" * 3000) + "x" * 120_000 + " " + "7" * 6000 + "\n" + "a b " * 20_000
#: Nulls in every column, empty and very long texts, ties and repeated rows.
EDGE = [
    (1, "Shared line of text\nown one\n", "en", "a", 1),
    (2, "  SHARED line of text\t\nother words stand here", "en", "a", 2),
    (2, "  SHARED line of text\t\nother words stand here", "en", "a", 2),
    (3, None, None, None, None),
    (4, "", "de", "b", 0),
    (None, "shared line of text\nmail a@b.co or call +1 (555) 010-2000", "en", None, None),
    (6, "É é shared\n\n \x0b\nIP 10.0.0.1 card 4111 1111 1111 1111", None, "b", 5),
    (7, "one two three four five six seven eight nine ten one two three four five", "en", "a", 9),
    (8, LONG, "en", "b", len(LONG)),
    (9, "😀 naïve\n" * 4, "fr", "c", 3),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), SQL[name], sf)


# --- 1


def test_line_dedup_edges(edge, empty):
    out = line_dedup.line_dedup(edge.withColumn("N_LINES", F.lit("x")).withColumn("ld_id", F.lit("y")))
    got = [tuple(r) for r in out.select("doc_id", "_n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()]
    assert ordered(got) == ordered(brute.lines([(r[0], r[1]) for r in EDGE]))
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_threshold(spark):
    df = spark.createDataFrame([(1, "a common line\nrare line two"), (2, "a common line\nrare line two"), (3, "a common line")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, min_docs=3).collect()}
    assert got == {1: "a common line\nrare line two", 2: "rare line two", 3: ""}


# --- 2

PAGES = [(1, "http://a", "x" * 100), (2, "http://b é", "x" * 100), (3, "u", "y" * 99), (4, "u", "y" * 99), (5, None, None), (None, "n", "x" * 100), (6, "big", "é" * 300_000), (2, "again", "x" * 100)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    log = warc.write_warc(pages, f"file://{tmp_path}/w")
    assert log.agg(F.sum("records")).first()[0] == len(PAGES)
    got = warc.read_warc(spark, f"file://{tmp_path}/w")
    kinds = Counter((r["warc_type"], r["record_id"], r["refers_to"], r["http_length"]) for r in got.collect())
    want = Counter({("response", "<urn:page:1>", None, 100): 1, ("revisit", "<urn:page:2>", "<urn:page:1>", 100): 2, ("revisit", "<urn:page:null>", "<urn:page:1>", 100): 1, ("response", "<urn:page:3>", None, 99): 1, ("response", "<urn:page:4>", None, 99): 1, ("response", "<urn:page:5>", None, 0): 1, ("response", "<urn:page:6>", None, 600_000): 1})
    assert kinds == want
    big = got.where("record_id = '<urn:page:6>'").first()
    assert big["payload"].decode() == "é" * 300_000
    only = warc.read_warc(spark, f"file://{tmp_path}/w", payload=False).where("warc_type = 'revisit'")
    assert only.count() == 3 and all(r["payload"] is None for r in only.collect())
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("offset",), 3)]))
    assert len(left) == 1 and reader.wanted == {"warc_type": {"revisit"}}
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/empty")
    assert warc.read_warc(spark, f"file://{tmp_path}/empty").count() == 0


def test_warc_foreign_files(spark, tmp_path):
    import gzip

    recs = [warc.record("response", str(k), f"u{k}", "d", None, b"payload" * k, 7 * k, "2020-01-01T00:00:00Z") for k in (1, 20_000, 3)]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    for name in ("a.warc", "b.warc.gz"):
        for payload in (True, False):
            got = warc.read_warc(spark, str(tmp_path / name), payload=payload).collect()
            assert [r["http_length"] for r in got] == [7, 140_000, 21]
            assert not payload or [bytes(r["payload"]) for r in got] == [b"payload" * k for k in (1, 20_000, 3)]
    empty = tmp_path / "none"
    empty.mkdir()
    assert warc.read_warc(spark, str(empty)).count() == 0


# --- 3


def exact(vectors: dict[int, np.ndarray], ids, k=20):
    out = {}
    names = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in names])
    for q in ids:
        s = np.cumsum(x * vectors[q], axis=1)[:, -1]
        s[names == q] = -np.inf
        out[q] = [(int(names[j]), float(s[j])) for j in np.lexsort((names, -s))[:k] if np.isfinite(s[j])]
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_ann_recall(spark, sf, size):
    folder = sf.replace("sf0.001", size)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows}
    want = exact(vectors, [i for i in vectors if i % 20 == 0])
    got = defaultdict(list)
    for r in queries.op3_multi_index(spark, folder).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        for _, v, s in found:
            assert v != q and s == pytest.approx(float(vectors[v] @ vectors[q]), abs=1e-12)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, float(k % 3), 2.0]) for k in range(1, 30)] + [(40, None), (60, [0.0, 0.0, 0.0]), (80, [nan, 1.0, 1.0]), (100, [inf, 1.0, 1.0]), (120, [1.0, None, 1.0]), (140, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x"))
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=5, probe=1.0, block=4).orderBy("query_id", "rank").collect()
    want = exact({k: np.array(v) for k, v in rows[:29]}, [20], 5)[20]
    assert [(r["vec_id"], r["score"]) for r in got] == want
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.search(df.where("vec_id in (20, 3)"), F.col("vec_id") % 20 == 0, k=20).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(20, 3)]


def test_walk_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = ann.walk(a, b, np.ones(35, dtype=int), 35)
    sums = [a[c // 5] + b[c % 5] for c in got]
    assert len(set(got)) == 35 and all(x >= y - 1e-12 for x, y in zip(sums, sums[1:]))


# --- 4


def check_lm(rows, docs):
    want = brute.lm_base(docs)
    for r in rows:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert r["score"] < 0


@pytest.mark.parametrize("hot", [0, 50])
def test_lm_base(spark, sf, hot):
    docs = common.table(spark, sf, "documents")
    out = lm_score.lm_score(docs, queries._vocabulary("piece_bpe_32k.model"), hot=hot).collect()
    assert len(out) == docs.count()
    check_lm(out, pairs(docs))
    path = queries._vocabulary("piece_bpe_32k.model")
    want = brute.lm_scores(pairs(docs), path, lm_score.vocabulary(path)[0])
    for r in out:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_lm_edges(edge, empty):
    path = queries._vocabulary("piece_bpe_32k.model")
    out = lm_score.lm_score(edge.withColumn("word", F.lit(1)), path).collect()
    assert len(out) == len(EDGE)
    check_lm(out, [(r[0], r[1]) for r in EDGE])
    assert lm_score.lm_score(empty, path).count() == 0


def test_lm_of_a_unigram_vocabulary(spark, monkeypatch):
    """Log probabilities are used as they are; and a model without training documents is the lattice."""
    monkeypatch.setattr(lm_score, "vocabulary", lambda path: ([b" ", b"a", b" a", b"b"], True))

    class Scores:
        def __init__(self, model_file):
            pass

        def get_score(self, k):
            return (-1.0, -2.0, -1.5, -2.5)[k]

    import sentencepiece

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Scores)
    lattice = lm_score.learn(None, "x")
    e = np.exp(1)
    assert lattice.log10(b"ab") == pytest.approx(np.log10((e**-1.5 + e**-3.0) * e**-2.5))
    model = lm_score.Model(lattice, 0, 0)
    assert model.log10(b"ab", 0) == pytest.approx(lattice.log10(b"ab")) and model.end(0) == 0.0
    seen = lm_score.Model(lattice, 10, 4)
    assert 10 ** seen.log10(b"a", 3) == pytest.approx(2.25 / 10 + 3.0 / 10 * 10 ** lattice.log10(b"a"))


def test_lattice():
    weights = {b" ": -1.0, b" a": -0.5, b"a": -0.7, b"ab": -0.9, b"b": -1.1, b"ba": -2.0, b"\xc3": -3.0, b"\xa9": -3.0}
    lattice = lm_score.Lattice(weights)
    for word in (b"a", b"ab", b"abab", b"bbb", "aé".encode(), b"ab" * 200):
        assert lattice.log10(word) == pytest.approx(brute.spellings(word, weights), rel=1e-9)
    # A proper distribution: no more than 1 over all words, the end included.
    assert sum(10 ** v for v in (lattice.log10(w) for w in (b"a", b"b", b"ab", b"ba", b"aa", b"bb"))) < 1


def test_lm_held_out_within_half_of_base(spark, sf):
    """On held-out texts the log probability may be below the base, which gives all unseen words
    together the mass of one, but by less than a half."""
    out = queries.op4_lm_score(spark, sf.replace("0.001", "0.01")).where("held_out and n_known < n_tokens").agg(F.avg("score"), F.avg("base_score")).first()
    assert out[0] > out[1] * 1.5


# --- 5


def check_pii(rows, docs):
    texts = Counter(docs)
    for r in rows:
        match = [t for (i, t) in texts if i == r["doc_id"] and brute.base_row(t) == (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])]
        assert match, r
        base = {f"{k}:{a}:{b}" for k, v in brute.base_spans(match[0]).items() for a, b in v}
        assert base <= set(filter(None, r["spans"].split(",")))


def pii_rows(df):
    spans = F.col("pii")
    out = pii.pii_spans(df).select("doc_id", "pii")
    count = lambda k: F.size(F.filter(spans, lambda c: c["base"] & (c["kind"] == k)))
    return out.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(pii.KINDS)], F.sha2(pii.show(spans, lambda c: c["base"]).cast("binary"), 256).alias("base_sha256"), pii.show(spans, lambda c: F.lit(True)).alias("spans")).collect()


def test_pii_base(spark, sf):
    docs = common.table(spark, sf.replace("0.001", "0.01"), "documents")
    rows = queries.op5_pii(spark, sf.replace("0.001", "0.01")).collect()
    assert len(rows) == docs.count()
    check_pii(rows, pairs(docs))


HARD = [
    "a@b.c_d@e.f g@@h.i @x.y a.b@c a@b..c x@y.z. +é@b.co",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.0002.0003.0255 1.2.3 9.9.9.9.9",
    "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 41111111111111111111111 4111  1111 1111 1111",
    "+1 (555) 010-2000 +12 3 ++1 234 567 8901 +1.2.3.4.5.6.7.8.9 +1-800 +49 30 1234567 +",
    "12 4111111111111111 5 6 7 10.1.2.3 +44 20 7946 0958 9 8 7",
    "5555 5555 5555 4444 +1 555 555 5555 1.1.1.1",
    "é😀 4111 1111 1111 1111 😀 a@b.co 😀 1.1.1.1",
    ("+1 555 010 2000, " * 200) + ("4111 1111 1111 1111\n" * 150),
    "0 " * 5000 + "a" * 50_000 + "@b.c",
]


def test_pii_hard(spark, edge, empty):
    docs = [(k, t) for k, t in enumerate(HARD)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pii_raw_", F.lit(1))
    rows = pii_rows(df)
    assert len(rows) == len(docs)
    check_pii(rows, docs)
    rows = pii_rows(edge)
    assert len(rows) == len(EDGE)
    check_pii(rows, [(r[0], r[1]) for r in EDGE])
    assert pii.pii_spans(empty).count() == 0


def test_pii_adds_spans(spark):
    true = ["call (555) 012-3456 now", "tel 030 1234 5678 now", "write to jo.do [at] mail [dot] com please", "card 4111.1111.1111.1111 ok", "amex 3782 822463 10005 ok", "server 10[.]0[.]0[.]7 is up"]
    false = ["order 1234567890 shipped", "on 2024-01-15 we met", "pi is 3.14159265358979", "look at them . Then", "isbn 978-3-16-148410-0", "total 1 2 3 4 5 6 7 8 9"]
    df = spark.createDataFrame(list(enumerate(true + false)), "doc_id long, text string")
    got = {r["doc_id"]: r["pii"] for r in pii.pii_spans(df).collect()}
    caught = [bool(got[k]) for k in range(len(true))]
    assert sum(caught) >= 5, caught
    assert not any(got[len(true) + k] for k in range(len(false))), got


def test_pii_held_out_accuracy(spark):
    trees, limits = pii.model(spark)
    x, y = pii._scored_rows(spark, pii.labelled_rows(900, seed=77))
    score = pii.RATE * sum(pii.tree_value(t, x) for t in trees)
    said = score >= np.array(limits)[x[:, 0]]
    assert y[said].mean() >= 0.93 and said[y == 1].mean() >= 0.8


def test_pii_redacts(spark):
    df = spark.createDataFrame([(1, "é a@b.co, 10.0.0.1!"), (2, "none")], "doc_id long, text string")
    out = pii.pii_spans(df).select("doc_id", pii.redact(F.col("text"), F.col("pii"))).orderBy("doc_id").collect()
    assert [r[1] for r in out] == ["é [email], [ip]!", "none"]


# --- 6


def check_pieces(pieces, docs, window=2048):
    import public_tokenizers
    import tokenizers

    exact = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t)
    for i, ts in texts.items():
        ids = np.array(exact.encode(ts[0] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted(by_doc[i], key=lambda p: p["start"])
        if len(ts) == 1:
            assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
        assert sum(p["length"] for p in own) == len(ids) * len(ts)
        for p in own:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    used = padded = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == [0, *np.cumsum([p["length"] for p in ps])[:-1]]
        n = sum(p["length"] for p in ps)
        assert 0 < n <= window
        used, padded = used + n, padded + (n if n & (n - 1) == 0 else window)
    return used / padded


def test_pack(spark, sf):
    docs = common.table(spark, sf, "documents")
    assert check_pieces(queries.op6_pack(spark, sf).collect(), pairs(docs)) > 0.98


def test_pack_edges(edge, empty):
    path = queries._vocabulary("byte_bpe_50k.json")
    check_pieces(packing.pack(edge, path).collect(), [(r[0], r[1]) for r in EDGE])
    assert packing.pack(empty, path).count() == 0


def test_plan_is_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 12, size=14))])
        penalty = rng.integers(0, 5, size=len(places)).astype(float)
        penalty[0] = 0
        window = 32

        def cost(cuts):
            at = {p: k for k, p in enumerate(places.tolist())}
            total = 0.0
            for a, b in zip(cuts, cuts[1:]):
                n = b - a
                total += penalty[at[b]] + (0 if n & (n - 1) == 0 and n >= 8 else window - n)
            return total

        best = {0: 0.0}
        for i in range(1, len(places)):
            options = [best[j] + cost([places[j], places[i]]) for j in range(i) if places[i] - places[j] <= window]
            best[i] = min(options)
        assert cost(packing.plan(places, penalty, window).tolist()) == pytest.approx(best[len(places) - 1])


# --- 7


def test_shard_law(spark, sf):
    docs = common.table(spark, sf, "documents")
    rows = queries.op7_shard(spark, sf).collect()
    check_shards(rows, docs.count())
    texts = dict(pairs(docs))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    mixture = defaultdict(Counter)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
        mixture[source[r["doc_id"]]][r["shard"]] += 1
    for per in mixture.values():
        assert max(per[s] for s in range(8)) - min(per[s] for s in range(8)) <= 2
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op7_shard(spark, sf).collect()))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == brute.shards([tuple(r) for r in docs.collect()])


def check_shards(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(8)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(8))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shard_edges(spark, edge, empty):
    fix = lambda df: df.select(F.col("sh_shard").alias("shard"), F.col("sh_slot").alias("slot")).collect()
    check_shards(fix(sharding.shard_plan(edge.withColumn("sh_rank", F.lit(1)), 8, carry=["doc_id", "sh_rank"])), len(EDGE))
    check_shards(fix(sharding.shard_plan(edge, 8, bucket_rows=2)), len(EDGE))
    assert sharding.shard_plan(empty, 8).count() == 0
    many = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    check_shards(fix(sharding.shard_plan(many, 8, bucket_rows=10)), 1003)


# --- 8


def test_mix_edges(edge, empty):
    plan = mixing.mix_plan(edge, ["doc_id", "text"]).collect()
    assert len(plan) == len(EDGE)
    for r in plan:
        assert r["mix_size"] == len(brute.WORD.findall(r["text"] or "")) and 0 <= r["mix_copies"] <= 2
    sizes = defaultdict(int)
    for r in EDGE:
        sizes[r[3]] += len(brute.WORD.findall(r[1] or ""))
    target = {}
    left, weights = 1.5 * sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (5, 2, 1, 5)))
    free = set(sizes)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    source = {r[0]: r[3] for r in EDGE}
    for r in plan:
        assert r["mix_target"] == pytest.approx(target[source[r["doc_id"]]]) and r["mix_source_size"] == sizes[source[r["doc_id"]]]
    assert mixing.mix_plan(empty, ["doc_id"]).count() == 0
    clash = edge.withColumn("mix_size", F.lit("x")).withColumn("rate", F.lit("y"))
    mixed = mixing.mix(clash)
    assert mixed.columns == clash.columns and mixed.count() == sum(r["mix_copies"] for r in plan)


def test_mix_is_near_targets(spark, sf):
    out = queries.op8_mix(spark, sf.replace("0.001", "0.1"))
    for r in out.join(common.table(spark, sf.replace("0.001", "0.1"), "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.15)


# --- 9


def test_simhash(spark, sf):
    docs = common.table(spark, sf.replace("0.001", "0.01"), "documents")
    got = [tuple(r) for r in queries.op9_simhash(spark, sf.replace("0.001", "0.01")).collect()]
    have = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got) == sorted(brute.simhash(have))


def test_simhash_dedup_edges(edge, empty):
    kept = simhash.simhash_dedup(edge.withColumn("FP", F.lit("x")).withColumn("si_row", F.lit(0)))
    assert kept.columns[-2:] == ["FP", "si_row"]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8, 9]
    assert simhash.simhash_dedup(empty).count() == 0


def test_trie_links():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 60, 700):
        seeds = rng.integers(0, 1 << 63, size=max(1, n // 5), dtype=np.uint64)
        noise = [sum({1 << int(b) for b in rng.integers(0, 64, size=rng.integers(0, 4))}) for _ in range(n)]
        x = np.unique(np.array([seeds[k % len(seeds)] ^ np.uint64(v) for k, v in enumerate(noise)], dtype=np.uint64))
        parent = simhash.trie_links(x, None, 2)
        cut = len(x) // 2
        a, b = x[::2], x[1::2]
        two = simhash.trie_links(a, b, 2)
        order = np.concatenate([np.arange(0, len(x), 2), np.arange(1, len(x), 2)])
        for got, edges, index in ((parent, [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 2], np.arange(len(x))), (two, [(i, j) for i in range(0, len(x), 2) for j in range(1, len(x), 2) if int(x[i] ^ x[j]).bit_count() <= 2], order)):
            root = list(range(len(x)))

            def up(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i, j in edges:
                root[up(i)] = up(j)
            groups = defaultdict(set)
            for at, i in enumerate(index):
                groups[got[at]].add(up(i))
            assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({up(i) for i in range(len(x))}), (n, cut)


def test_components_of_chains(spark):
    rng = np.random.default_rng(4)
    ids = rng.permutation(400)
    edges = [(int(ids[k]), int(ids[k + 1])) for k in range(399) if k % 100 != 99] + [(5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in range(4):
        chain = [int(i) for i in ids[part * 100 : part * 100 + 100]]
        assert len({got[i] for i in chain}) == 1
    assert len(set(got.values())) == 4


# --- 10


def test_quality_edges(edge, empty):
    df = edge.withColumn("q_words", F.lit("x")).withColumn("g_lang", F.lit("y"))
    rows = quality.quality_verdicts(df).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        want = brute.quality(r["text"])
        assert tuple(r[f"q_{n}"] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["q_base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["q_base_failed"] and r["q_kept"])
    assert quality.quality_verdicts(empty).count() == 0


def test_quality_keeps_clean(spark, sf):
    out = queries.op10_quality(spark, sf.replace("0.001", "0.1"))
    good = common.table(spark, sf.replace("0.001", "0.1"), "labels").where("quality = 1 and toxic = 0").join(out, "doc_id").where("not base_failed")
    assert good.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.97


# --- the pipeline


def test_pipeline(spark, sf, tmp_path):
    """Against plain Python versions of all stages, with near copies of single lines besides."""
    docs = [tuple(r) for r in common.table(spark, sf, "documents").collect()]
    long = [d for d in docs if len((d[1] or "").split()) > 60][:12]
    for k, d in enumerate(long):
        words = d[1].split()
        for at, text in ((10_000, words), (20_000, [*words[:-1], "Other"])):
            docs.append((at + k, " ".join(text), d[2], d[3], len(" ".join(text))))
    sf = str(tmp_path)
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{sf}/documents.parquet")
    good = brute.quality_kept(docs)
    docs = [d for d in docs if d[0] in good]
    cut = {i: (len(all_) - len(kept), "\n".join(kept)) for i, all_, kept in brute.kept_lines([(d[0], d[1]) for d in docs])}
    docs = [(d[0], cut[d[0]][1], *d[2:]) for d in docs if not cut[d[0]][0] or brute.WORD.search(cut[d[0]][1])]
    own = set(brute.near_kept(docs))
    assert len(own) < len(docs)
    docs = [d for d in docs if d[0] in own]
    taken = brute.copies(docs)
    mixed = [(d[0], d[1]) for d in docs for _ in range(taken[d[0]])]
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert check_pieces(pieces, mixed) > 0.97
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(i for i, _ in mixed)


def test_pipeline_stages_take_odd_tables(spark, sf, edge, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        out = stage(spark, edge.withColumn("extra", F.lit(1)), sf)
        assert out.count() > 0 and (stage is corpus_pipeline.packed or out.columns == [*edge.columns, "extra"])
