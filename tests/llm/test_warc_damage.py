"""Archives with several records in a member, and damaged ones."""

from __future__ import annotations

import gzip
import io

import pytest
from pyspark.errors import PySparkException

from pointlake.llm import warc

RECORDS = [warc.record("response" if k % 2 else "revisit", str(k), f"u{k}", "d", "1", b"payload" * n, 7 * n, "2020-01-01T00:00:00Z") for k, n in enumerate((1, 20_000, 3, 0, 50_000))]


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def ids(data: bytes, fits=lambda h: True, payload=True):
    return [h["warc-record-id"] for _, h, _ in warc.records(File(data), fits, payload, "x")]


ALL = [f"<urn:page:{k}>" for k in range(5)]
FORMS = {
    "plain": b"".join(RECORDS),
    "one member": gzip.compress(b"".join(RECORDS)),
    "a member each": b"".join(map(gzip.compress, RECORDS)),
    "two members": gzip.compress(b"".join(RECORDS[:2])) + gzip.compress(b"".join(RECORDS[2:])),
    "skip lengths": b"".join(warc.member(r, 1) for r in RECORDS),
    "skip lengths, several records": warc.member(b"".join(RECORDS[:3]), 1) + warc.member(b"".join(RECORDS[3:]), 1),
    "empty members": gzip.compress(b"") + gzip.compress(b"".join(RECORDS)) + gzip.compress(b""),
    "padded": b"".join(RECORDS) + b"\r\n" * 3,
    "zeros": gzip.compress(b"".join(RECORDS)) + b"\0" * 100_000,
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("payload", [True, False])
def test_all_records(form, payload):
    assert ids(FORMS[form], payload=payload) == ALL
    assert ids(FORMS[form], lambda h: h["warc-type"] == "response", payload) == ALL[1::2]
    blocks = [b for _, _, b in warc.records(File(FORMS[form]), lambda h: True, payload, "x")]
    for k, b in enumerate(blocks):
        head, _, body = b.partition(b"\r\n\r\n")
        assert head.startswith(b"HTTP/1.1 200 OK")
        assert not payload or k % 2 == 0 or len(body) == 7 * (20_000 if k == 1 else 0)


@pytest.mark.parametrize("form", ["plain", "one member", "a member each", "skip lengths"])
def test_cut_archives_raise(form):
    data = FORMS[form]
    for stop in (len(data) - 5_000 if form == "plain" else len(data) - 12, len(data) // 2, 40):
        with pytest.raises(warc.Damaged):
            ids(data[:stop])


def test_other_damage_raises():
    flipped = bytearray(FORMS["one member"])
    flipped[-6] ^= 1  # the checksum
    foreign = b"<html>" * 100
    lengthless = RECORDS[0].replace(b"Content-Length: ", b"Content-Size: ", 1)
    for data in (bytes(flipped), FORMS["plain"] + foreign, foreign, FORMS["one member"] + foreign, lengthless.replace(b"Content-Length", b"Content-Size")):
        with pytest.raises(warc.Damaged):
            ids(data)


def test_damage_fails_the_query(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(FORMS["a member each"][:-12])
    with pytest.raises(PySparkException, match="damaged"):
        warc.read_warc(spark, str(tmp_path)).count()


def test_only_committed_files_count(spark, tmp_path):
    path = f"{tmp_path}/w"
    pages = spark.range(1, 40).selectExpr("id as page_id", "'u' as url", "repeat('x', int(id)) as html").repartition(2)
    warc.write_warc(pages, f"file://{path}", roll=2000)
    names = {p.name for p in (tmp_path / "w").glob("*.warc.gz")}
    # What a lost attempt may leave after the job has ended.
    (tmp_path / "w" / "part-000000-999999-0007.warc.gz").write_bytes(FORMS["a member each"])
    got = warc.read_warc(spark, f"file://{path}")
    assert got.count() == 39 and {r["file"].rsplit("/", 1)[1] for r in got.select("file").distinct().collect()} == names
    with pytest.raises(PySparkException):
        warc.write_warc(pages, f"file://{path}")
    (tmp_path / "w" / "_log" / "_SUCCESS").unlink()
    with pytest.raises(PySparkException, match="did not finish"):
        warc.read_warc(spark, f"file://{path}").count()
