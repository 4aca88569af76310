"""WARC archives: a writer with payload dedup, and a Python data source.

Writing: of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest
id is a response and the others are revisits that refer to it. Each task attempt writes archives of
its own; Spark commits one attempt of each task, and the table of what that one wrote, in the
archives' folder, is what counts: a reader takes the files that it names and no others, and files of
lost or repeated attempts are removed. Records are gzip members whose extra field "sl" holds their
packed and unpacked length, so that a reader can skip a record after its headers.

Reading: files are planned into partitions by size. Predicates on the record type and other headers
are pushed down; headers are parsed first, and the payload of a record that is not wanted is neither
unpacked nor read where the member's skip lengths allow it. A gzip member may hold any number of
records. A damaged archive (cut short, a wrong checksum in what is unpacked, no record where one
should begin) is an error that names the file and the place.

Paths may be of any store that pyarrow.fs opens (local, hdfs, s3, gs).

Edge cases: a null payload is empty; a null id is written as "null", sorts last, and reads back as
null; ids are of an integer type; rows that share the smallest id of a payload are all responses; an
empty table makes no archive, and an empty folder reads as an empty table. A very long payload is one
record, held in memory by the task that writes or reads it. Other columns of the input, whatever
their names, are not archived.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import NULL_ID, numbered, small_side

SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, headers map<string,string>, payload binary, file string, offset long"
#: Column: the header it is.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
ROLL = 256 << 20
#: In the archives' folder: the table of the files that count.
LOG = "_log"
#: Bytes read at once.
CHUNK = 1 << 16
#: Of a batch of rows handed to Spark, at most about.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _open(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path)) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def member(record: bytes, level: int) -> bytes:
    """A gzip member with the skip lengths in its extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF) + body + tail


def record(kind: str, ident: str, uri: str, digest: str, refers_to: str | None, payload: bytes, full: int, date: str) -> bytes:
    block = _HTTP % full + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{ident}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, level: int = 1, date: str = "2020-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Write the archives to a new folder and return (file, records, bytes), already written.

    The table of repeated digests aggregates map-side, is written and measured: while it is small it
    is broadcast and no payload moves; beyond that payloads move once, to meet it, by a plain join
    that AQE splits where one payload is hot.
    """
    table, at = numbered(pages, "w_")
    rows = table.select(F.col(at(id_col)).cast("long").alias("id"), F.col(at(url_col)).cast("string").alias("url"), F.coalesce(F.col(at(payload_col)).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload"), "at": F.coalesce("id", F.lit(NULL_ID))})
    repeated = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least < most")
    repeated = small_side(repeated.select("digest", "least"), "warc-repeats", ["digest"])
    typed = rows.join(repeated, "digest", "left").select("id", "url", "digest", "size", F.when(F.col("least") < F.col("at"), F.col("least")).alias("refers_to"), F.when(F.col("least") < F.col("at"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"))

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, fs_path = _open(path)
        task = TaskContext.get()
        out, made, name, n, size = None, [], "", 0, 0

        def close() -> None:
            out.close()
            made.append((name, n, size))

        for b in it:
            cols = [b.column(k).to_pylist() for k in range(6)]
            for ident, url, digest, full, refers, payload in zip(*cols):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    own.create_dir(fs_path, recursive=True)
                    out, n, size = own.open_output_stream(f"{fs_path}/{name}", compression=None), 0, 0
                show = "null" if ident is None else str(ident)
                uri = quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")
                data = member(record("response" if refers is None else "revisit", show, uri, digest, None if refers is None else str(refers), payload, full, date), level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*made) if made else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    spark, log = pages.sparkSession, f"{path}/{LOG}"
    typed.mapInArrow(write, "file string, records long, bytes long").write.parquet(log)  # an error if the folder has one
    own, fs_path = _open(path)
    committed = _committed(own, fs_path) or set()
    for f in _archives(own, fs_path):
        if f.base_name not in committed:
            own.delete_file(f.path)
    return spark.read.parquet(log)


def _archives(own, path: str) -> list:
    from pyarrow import fs

    found = own.get_file_info(fs.FileSelector(path, recursive=True))
    return [f for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path) and not f.base_name.startswith(".")]


def _committed(own, path: str) -> set[str] | None:
    """The names in the log of a folder that ``write_warc`` wrote; None for other folders."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    log = f"{path}/{LOG}"
    if own.get_file_info(log).type != fs.FileType.Directory:
        return None
    files = [f for f in own.get_file_info(fs.FileSelector(log)) if f.base_name.endswith(".parquet")]
    if not any(f.base_name == "_SUCCESS" for f in own.get_file_info(fs.FileSelector(log))):
        raise ValueError(f"{path}: writing this folder did not finish")
    return {x for f in files for x in pq.ParquetFile(own.open_input_file(f.path)).read(columns=["file"])["file"].to_pylist()}


class WarcSource(DataSource):
    """spark.read.format("warc").option("path", folder or file). Options: payload (false: null payloads),
    split_bytes (of files read by one task, at most), least_splits (how many tasks to aim at)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.split, self.least = int(options.get("split_bytes", 128 << 20)), int(options.get("least_splits", 1))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        own, path = _open(self.path)
        info = own.get_file_info(path)
        whole = info.type == fs.FileType.Directory
        committed = _committed(own, path) if whole else None
        files = sorted((f.path, f.size) for f in (_archives(own, path) if whole else [info]) if committed is None or f.base_name in committed)
        split = min(self.split, max(1 << 20, sum(n for _, n in files) // self.least))
        parts, held = [[]], 0
        for f, size in files:
            if parts[-1] and held + size > split:
                parts.append([])
                held = 0
            parts[-1].append((f, size))
            held += size
        return [Files(p) for p in parts]

    def read(self, partition):
        own, _ = _open(self.path)
        rows, size = [], 0
        for path, _size in partition.files:
            with own.open_input_file(path) as f:
                for offset, headers, block in records(f, self._fits, self.payload, path):
                    rows.append(self._row(path, offset, headers, block))
                    size += len(block)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _fits(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c].lower()) in v for c, v in self.wanted.items())

    def _row(self, path, offset, headers, block):
        http, gap, payload = block.partition(b"\r\n\r\n") if "application/http" in headers.get("content-type", "") else (b"", b"", block)
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length = int(m[1]) if m else int(headers["content-length"]) - len(http) - len(gap)
        return (*[headers.get(h.lower()) for h in HEADERS.values()], length, list(headers.items()), payload if self.payload else None, path, offset)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.string()] * len(HEADERS), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64())
    names = (*HEADERS, "http_length", "headers", "payload", "file", "offset")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


class Damaged(ValueError):
    """An archive that is not what its lengths or checksums say."""


class Plain:
    """Bytes of an uncompressed archive from ``at`` on. ``text`` is what is read ahead, from ``place`` on."""

    def __init__(self, f, at: int):
        self.f, self.at, self.place, self.text = f, at, 0, b""

    def more(self, n: int = CHUNK) -> bool:
        """Read ahead; False at the end."""
        self.f.seek(self.at + self.place + len(self.text))
        got = self.f.read(max(n, CHUNK))
        self.text += got
        return bool(got)

    def drop(self, n: int) -> int:
        """Forget up to n bytes that come next; how many there were."""
        size = self.f.size() - self.at
        end = min(size, self.place + n)
        n, self.text, self.place = end - self.place, self.text[n:], end
        return n

    def take(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        if len(self.text) < n:
            self.more(n - len(self.text))
        out = self.text[:n]
        self.drop(len(out))
        return out

    def until(self, mark: bytes, most: int | None = None) -> int:
        """Where the mark is in ``text``, read ahead as far as need be (to ``most`` bytes); -1 if nowhere."""
        seen = 0
        while (at := self.text.find(mark, max(0, seen - len(mark) + 1))) < 0:
            seen = len(self.text)
            if (most is not None and seen >= most) or not self.more():
                return -1
        return at


class Member(Plain):
    """The unpacked bytes of the gzip member that begins at ``at``; zlib checks its length and checksum."""

    def __init__(self, f, at: int, raw: bytes):
        super().__init__(f, at)
        self.length, self.whole = _skip_lengths(raw)
        self.unpack, self.packed, self.feed = zlib.decompressobj(31), raw, at + len(raw)

    def more(self, n: int = 1 << 14) -> bool:
        while not self.unpack.eof:
            if not self.packed:
                self.f.seek(self.feed)
                self.packed = self.f.read(CHUNK)
                self.feed += len(self.packed)
                if not self.packed:
                    raise Damaged("the file ends within a gzip member")
            try:
                got = self.unpack.decompress(self.packed, max(n, 1 << 14))
            except zlib.error as e:
                raise Damaged(str(e)) from e
            self.packed = self.unpack.unconsumed_tail
            if got:
                self.text += got
                return True
        return False

    def drop(self, n: int) -> int:
        gone = 0
        while True:
            k = min(n - gone, len(self.text))
            self.text, gone, self.place = self.text[k:], gone + k, self.place + k
            if gone == n or not self.more(1 << 16):
                return gone

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.text and not self.more(n - have):
                break
            parts.append(self.text[: n - have])
            have += len(parts[-1])
            self.text = self.text[len(parts[-1]) :]
        self.place += have
        return b"".join(parts)

    def end(self) -> int:
        """The place in the file where the member ends, all of it unpacked."""
        while self.drop(1 << 20):
            pass
        return self.feed - len(self.unpack.unused_data)


def records(f, fits, payload: bool = True, name: str = "") -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record that ``fits``, from a file open for random access.

    The offset is the place in the file, or that of the record's gzip member. The block is unpacked
    after the headers fit; without ``payload`` only its first HTTP headers are. Raises Damaged.
    """
    size, at, near, window = f.size(), 0, 0, b""
    while at < size:
        if at + 4096 > near + len(window) and near + len(window) < size or at < near:
            f.seek(at)
            near, window = at, f.read(min(CHUNK, size - at))
        raw = window[at - near :]
        packed = raw[:2] == b"\x1f\x8b"
        try:
            if not packed and not raw.strip(b"\0"):  # padding, if the rest is like it
                f.seek(at + len(raw))
                if not f.read().strip(b"\0"):
                    return
            stream = Member(f, at, raw) if packed else Plain(f, at)
            for place, headers, block in _records_in(stream, fits, payload):
                yield at if packed else at + place, headers, block
            at = (at + stream.length if stream.place < 0 else stream.end()) if packed else size
        except Damaged as e:
            raise Damaged(f"{name}: damaged at byte {at}: {e}") from e


def _records_in(stream: Plain, fits, payload: bool) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records of a stream. If skip lengths told that a member's first record fills it, and the rest
    was not needed, the stream's place is -1 afterwards."""
    while True:
        while (stream.text or stream.more()) and stream.text[:1] in b"\r\n":
            stream.drop(len(stream.text) - len(stream.text.lstrip(b"\r\n")))
        if not stream.text:
            return
        place = stream.place
        while len(stream.text) < 5 and stream.more():
            pass
        if not stream.text.startswith(b"WARC/"):
            raise Damaged("no record begins here")
        stop = stream.until(b"\r\n\r\n")
        if stop < 0:
            raise Damaged("a record's headers have no end")
        headers = parse_headers(stream.text[:stop])
        if not headers.get("content-length", "").isdecimal():
            raise Damaged("a record has no Content-Length")
        n = int(headers["content-length"])
        stream.drop(stop + 4)
        fills = isinstance(stream, Member) and bool(stream.length) and place == 0 and stream.whole == (stop + 4 + n + 4) & 0xFFFFFFFF
        if fits(headers):
            if payload:
                block = stream.take(n)
                if len(block) < n:
                    raise Damaged("a record is cut short")
                n = 0
            else:
                stop = stream.until(b"\r\n\r\n", min(n, CHUNK))
                block = stream.text[:n][: stop + 4] if 0 <= stop <= n - 4 else b""
            yield place, headers, block
            if payload and fills:
                stream.end()  # checks the checksum
                return
        if fills:
            stream.place = -1
            return
        if stream.drop(n) < n:
            raise Damaged("a record is cut short")


def _skip_lengths(raw: bytes) -> tuple[int | None, int]:
    """(length of the gzip member, unpacked length) if its extra field "sl" tells."""
    if len(raw) >= 12 and raw[3] & 4:
        (n,) = struct.unpack_from("<H", raw, 10)
        extra = raw[12 : 12 + n]
        while len(extra) >= 4:
            (k,) = struct.unpack_from("<H", extra, 2)
            if extra[:2] == b"sl" and k == 8 and len(extra) >= 12:
                return struct.unpack_from("<II", extra, 4)
            extra = extra[4 + k :]
    return None, 0


def read_warc(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = 128 << 20) -> DataFrame:
    """The records. Sets spark.sql.python.filterPushdown.enabled for the session, which Spark reads when
    it plans a query: without it no predicate reaches the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("split_bytes", str(split_bytes)).option("least_splits", str(spark.sparkContext.defaultParallelism)).load()
