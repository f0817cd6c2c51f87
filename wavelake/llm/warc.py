"""WARC archives as a PySpark Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans one partition for each byte range of a file; the driver sees file
names and sizes only. A written file has one gzip member for each record and an
index of the members beside it, from which a task learns which of them begin in
its range. A compressed file without an index is one partition, as gzip cannot
be entered in its middle. A plain file is gone through from record to record by
the lengths in the headers until the range begins: nothing in a payload can
look like a record. A task reads the headers of a record first; predicates on
`record_type` and other header fields are pushed down and decide on them alone,
and the payload of a record that no one asked for, or that a predicate rejects,
is passed over without being inflated or decoded. What is not a record where one
should begin, or is cut off, is an error.

Columns: path, offset, record_id, record_type, target_uri, date, refers_to,
payload_digest, payload_length, payload. With `.option("payload", "false")`
payloads are skipped and null. The last two but one come from header fields,
of which `X-Full-Payload-Length` is an extension that also revisits carry.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "path string, offset bigint, record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length bigint, payload binary"
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MARK = b"WARC/1."
#: Bytes of a split.
SPLIT = 32 << 20


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else (path if not path.startswith("file:/") else "file://" + path[5:]))


class Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int, packed: bool = False, indexed: bool = False):
        self.path, self.start, self.end, self.packed, self.indexed = path, start, end, packed, indexed


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Take equality and IN on header fields; give back the rest to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = values & self.wanted[name] if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Slice]:
        from pyarrow import fs as pafs

        fs, base = filesystem(self.path)
        info = fs.get_file_info(base)
        files = [info, fs.get_file_info(base + ".idx")] if info.is_file else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        names = {f.path for f in files if f.is_file}
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.is_file and f.size and f.path.endswith((".warc", ".warc.gz")):
                packed, indexed = f.path.endswith(".gz"), f.path + ".idx" in names
                step = self.split if indexed or not packed else f.size
                out += [Slice(f.path, a, min(a + step, f.size), packed, indexed) for a in range(0, f.size, step)]
        return out or [Slice("", 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = filesystem(self.path)
        kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in SCHEMA.split(", "))])
        rows: list[dict] = []
        size = 0
        with fs.open_input_file(part.path) as handle:
            stream = Plain(handle, part)
            if part.packed:
                starts = None
                if part.indexed:
                    with fs.open_input_file(part.path + ".idx") as index:
                        starts = np.frombuffer(index.read(), dtype="<i8")
                stream = Members(handle, part, starts, bool(self.wanted) or not self.payload)
            for offset, head, length in records(stream):
                if all(head.get(FIELDS[name]) in values for name, values in self.wanted.items()):
                    row = {name: head.get(field) for name, field in FIELDS.items()} | {"path": part.path, "offset": offset}
                    row["payload_length"] = int(head["x-full-payload-length"]) if "x-full-payload-length" in head else None
                    if self.payload:
                        block = stream.take(length)
                        stream.skip(4)
                        row["payload"] = payload_of(block, head)
                        size += len(block)
                    else:
                        stream.pass_over(length)
                    rows.append(row)
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                else:
                    stream.pass_over(length)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def payload_of(block: bytes, head: dict[str, str]) -> bytes | None:
    """What follows the HTTP head; a revisit has no payload of its own."""
    if head.get("warc-type") == "revisit":
        return None
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records(stream) -> Iterator[tuple[int, dict[str, str], int]]:
    """Offset, header fields by lower-case name, and block length of each record of the range. The consumer takes the block and skips 4 bytes, or passes over both."""
    while (offset := stream.at_record()) is not None:
        head: dict[str, str] = {}
        stream.line()
        while line := stream.line().strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        if not head.get("content-length", "").isdigit():
            raise ValueError(f"{stream.name}: the record at {offset} has no Content-Length")
        length = int(head["content-length"])
        if offset < stream.start:
            stream.pass_over(length)
        else:
            yield offset, head, length


class Plain:
    """An uncompressed file, from its start; records count that begin in the range."""

    #: Bytes read at once, and while only headers are wanted on the way to the range.
    CHUNK, HEAD = 1 << 20, 4 << 10

    def __init__(self, handle, part: Slice):
        self.handle, self.name, self.start, self.end = handle, part.path, part.start, part.end
        self.size = handle.size()
        self.buffer, self.pos, self.base = b"", 0, 0

    def _more(self) -> bool:
        got = self.handle.read(self.CHUNK if self.base + self.pos >= self.start else self.HEAD)
        self.base += self.pos
        self.buffer, self.pos = self.buffer[self.pos :] + got, 0
        return bool(got)

    def at_record(self) -> int | None:
        here = self.base + self.pos
        if here >= self.end:
            return None
        while len(self.buffer) - self.pos < len(MARK) and self._more():
            pass
        if not self.buffer.startswith(MARK, self.pos):
            if self.pos < len(self.buffer):
                raise ValueError(f"{self.name}: no record begins at {here}")
            return None
        return here

    def line(self) -> bytes:
        while (at := self.buffer.find(b"\n", self.pos)) < 0:
            if not self._more():
                raise ValueError(f"{self.name}: a header is cut off")
        out = self.buffer[self.pos : at + 1]
        self.pos = at + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.pos < n:
            if not self._more():
                raise ValueError(f"{self.name}: a payload is cut off")
        out = self.buffer[self.pos : self.pos + n]
        self.pos += n
        return out

    def skip(self, n: int) -> None:
        self.take(n)

    def pass_over(self, length: int) -> None:
        """Go to the end of the record without reading it."""
        n = length + 4
        have = len(self.buffer) - self.pos
        if n <= have:
            self.pos += n
            return
        if self.base + self.pos + n > self.size:
            raise ValueError(f"{self.name}: a payload is cut off")
        self.base += self.pos + n
        self.buffer, self.pos = b"", 0
        self.handle.seek(self.base)


class Members(Plain):
    """Gzip members of the range: those that begin in it by the index, or without one all of the file.

    Where payloads are wanted members are read one after the other; where some
    are not, from the beginning of one to the beginning of the next that the
    index names.
    """

    #: Inflated at once where payloads are passed over: headers fit, and most of a payload stays packed.
    STEP = 2 << 10

    def __init__(self, handle, part: Slice, starts: np.ndarray | None, sparse: bool):
        super().__init__(handle, part)
        self.start, self.at, self.raw, self.engine = 0, 0, b"", None
        self.starts, self.sparse = None, False
        stop = self.size
        begin = 0
        if starts is not None:
            mine = np.flatnonzero((starts >= part.start) & (starts < part.end))
            # Each one's start, and where the last one ends.
            self.starts = [int(x) for x in starts[mine]]
            self.sparse = sparse
            stop = int(starts[mine[-1] + 1]) if len(mine) and mine[-1] + 1 < len(starts) else self.size
            begin = self.starts[0] if len(mine) else stop
            self.ends = [*self.starts[1:], stop]
        handle.seek(begin)
        self.left = stop - begin

    def at_record(self) -> int | None:
        if self.starts is not None:
            if self.at == len(self.starts):
                return None
            if self.sparse:
                self.handle.seek(self.starts[self.at])
                self.buffer, self.pos, self.raw, self.engine = b"", 0, b"", None
                self.left = self.ends[self.at] - self.starts[self.at]
            self.at += 1
        while len(self.buffer) - self.pos < len(MARK) and self._more():
            pass
        if not self.buffer.startswith(MARK, self.pos):
            if self.starts is None and self.pos == len(self.buffer):
                return None
            raise ValueError(f"{self.name}: no record begins at {self.base + self.pos} of what is inflated")
        return self.base + self.pos if self.starts is None else self.starts[self.at - 1]

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.handle.read(min(self.CHUNK, self.left))
                self.left -= len(self.raw)
                if not self.raw:
                    if self.engine is not None:
                        raise ValueError(f"{self.name}: a member is cut off")
                    return False
            if self.engine is None:
                self.engine = zlib.decompressobj(31)
            got = self.engine.decompress(self.raw, self.STEP if self.sparse else self.CHUNK)
            self.raw = self.engine.unconsumed_tail or self.engine.unused_data
            if self.engine.eof:
                self.engine = None
            if got:
                self.base += self.pos
                self.buffer, self.pos = self.buffer[self.pos :] + got, 0
                return True

    def pass_over(self, length: int) -> None:
        """With an index the rest of the member stays packed."""
        n = 0 if self.sparse else length + 4
        while n:
            step = min(n, len(self.buffer) - self.pos)
            self.pos += step
            n -= step
            if n and not self._more():
                raise ValueError(f"{self.name}: a payload is cut off")


class Committed(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows with record_id, record_type, target_uri, refers_to, payload_digest, payload_length and payload to .warc.gz files.

    Files are written under names of their attempt and take their final names
    when the job commits, so a task that is run again leaves no copies.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Committed:
        from pyspark import TaskContext

        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/_{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        written, rows, starts = 0, 0, array("q")
        with fs.open_output_stream(name, compression=None) as sink:
            for batch in batches:
                for row in batch.to_pylist():
                    engine = zlib.compressobj(3, zlib.DEFLATED, 31)
                    packed = engine.compress(record(row)) + engine.flush()
                    starts.append(written)
                    sink.write(packed)
                    written += len(packed)
                    rows += 1
        if sys.byteorder == "big":
            starts.byteswap()
        with fs.open_output_stream(name + ".idx", compression=None) as sink:
            sink.write(starts.tobytes())
        return Committed([name] if rows else [])

    def commit(self, messages: list[Committed]) -> None:
        fs, base = filesystem(self.path)
        for m in messages:
            for name in m.files if m else []:
                final = f"{base}/{name.rpartition('/')[2][1:]}"
                fs.move(name + ".idx", final + ".idx")
                fs.move(name, final)

    def abort(self, messages: list[Committed]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            for name in m.files if m else []:
                for x in (name, name + ".idx"):
                    try:
                        fs.delete_file(x)
                    except FileNotFoundError:
                        pass


def record(row: dict) -> bytes:
    """One WARC/1.1 record. Line breaks in header values become spaces."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else (row["payload"] or b"")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Refers-To", row["refers_to"]),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Payload-Digest", row["payload_digest"]), ("X-Full-Payload-Length", row["payload_length"]),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
    ]
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in head if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def register(spark) -> None:
    """Make the format known to the session and let predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages, path: str, least: int = 100):
    """Write (page_id, url, html) rows as records under `path`; equal payloads of `least` bytes or more are stored once.

    The record of smallest page_id is the response and the others revisit it;
    of rows that repeat that page_id one is the response and the others revisit
    it too. Null html is an empty payload; a null page_id gets a record without
    id that is always a response. An empty table writes no file; payloads of
    any length are written whole; other columns of pages are not read.
    """
    from pyspark.sql import functions as F

    from wavelake.llm.textkit import stored

    few = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least
    named = pages.filter(few & F.col("page_id").isNotNull()).select(F.col("page_id").alias("_order"), F.sha2(F.col("html").cast("binary"), 256).alias("_sha"))
    firsts = named.groupBy("_sha", "_order").agg(F.count(F.lit(1)).alias("_n")).groupBy("_sha").agg(F.min("_order").alias("_first"), F.min_by("_n", "_order").alias("_ties"), F.sum("_n").alias("_n"))
    # Written, so that the join deals out its sides anew and Spark can split a hot payload.
    firsts = stored(firsts.filter("_n > 1").drop("_n"), "warc-firsts")
    base = pages.select(F.col("page_id").alias("_order"), F.col("url").alias("target_uri"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    tied = not firsts.filter("_ties > 1").isEmpty()
    if tied:
        # Rows that share a page_id and a payload are told apart by a number, which is written to stay the same.
        base = stored(base.withColumn("_row", F.monotonically_increasing_id()), "warc-pages")
    base = base.withColumn("_sha", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("bigint"))
    revisit = F.col("_first").isNotNull() & (F.col("_order") != F.col("_first"))
    if tied:
        least_row = base.join(firsts.filter("_ties > 1"), "_sha").filter("_order = _first").groupBy("_sha").agg(F.min("_row").alias("_least"))
        firsts = firsts.join(stored(least_row, "warc-ties"), "_sha", "left")
        revisit = revisit | ((F.col("_order") == F.col("_first")) & (F.col("_row") != F.col("_least")))
    revisit = F.coalesce(revisit, F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    rows = base.join(firsts, "_sha", "left").select(
        urn(F.col("_order")).alias("record_id"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "target_uri",
        F.when(revisit, urn(F.col("_first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("_sha")).alias("payload_digest"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").save(path)
