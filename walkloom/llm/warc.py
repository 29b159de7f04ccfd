"""WARC files as a PySpark data source, read and written.

Reading: files become partitions (small ones together, up to ``partition_bytes``). Predicates on
record_type and on header columns are pushed down: a record's header block is parsed first, and
the payload of a record that a predicate rules out, or that is not asked for (``payload=false``), is
skipped without being decoded. Files may be gzip with one member per record, or plain.

A folder that was not written here has no manifest: all its ``*.warc`` and ``*.warc.gz`` files are read, subfolders
included. Header lines that begin with a blank continue the line above; of a repeated header the last counts. The payload of a record of type
``application/http`` is what follows the HTTP head (the whole block if it has none), its encodings left as they are.

Writing: every task writes one file per attempt under a name no other attempt has; the commit on
the driver lists the files of the successful attempts in a manifest of its own, which appears by a rename, and only listed files are
read. A lost executor or a second attempt leaves a file nobody reads. Appending adds a manifest, overwriting adds one that names
those it replaces, an aborted write adds none. Rows of one page_id with equal payloads are records of their own: both are the response if the id
is the largest. An empty table writes an empty manifest; columns other than the id, url and html are not looked at.

Folders are opened with ``pyarrow.fs``, so any store that it knows will do.
"""

from __future__ import annotations

import io
import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from walkloom.llm import idfilter
from walkloom.llm.common import cut

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, refers_to string, "
          "payload_digest string, payload_length long, content_length long, payload binary")
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
#: Column -> WARC header.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
           "payload_length": "x-payload-length"}
MANIFEST = "manifest"


def _store(path: str):
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


@dataclass
class Files(InputPartition):
    names: tuple


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int
    size: int


class WarcDataSource(DataSource):
    """Options: path (required), payload (default true), partition_bytes (read), compress (write)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, schema, overwrite)


def _manifests(store, root: str) -> dict[str, dict]:
    """The manifests in force: {file name: {"files": [...], "replaces": [...]}}."""
    from pyarrow import fs
    found = {}
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST) and info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                read = json.loads(f.read())
            found[info.base_name] = read if isinstance(read, dict) else {"files": read, "replaces": []}
    gone = {name for m in found.values() for name in m["replaces"]}
    return {name: m for name, m in found.items() if name not in gone}


def _listed(store, root: str) -> list[dict]:
    """Names and sizes of the files to read."""
    from pyarrow import fs
    manifests = _manifests(store, root)
    if manifests:
        return [entry for m in manifests.values() for entry in m["files"]]
    infos = store.get_file_info(fs.FileSelector(root, recursive=True))
    return [{"name": i.path[len(root):].lstrip("/"), "size": i.size} for i in infos
            if i.type == fs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.tests: list[tuple[str, frozenset]] = []
        self.present: list[str] = []

    def pushFilters(self, filters):
        """Takes equality, IN and IS NOT NULL on header columns; returns what it cannot take."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column in HEADERS:
                self.tests.append((column, frozenset([f.value])))
            elif isinstance(f, In) and column in HEADERS:
                self.tests.append((column, frozenset(f.value)))
            elif isinstance(f, IsNotNull) and column in HEADERS:
                self.present.append(column)
            else:
                yield f

    def partitions(self):
        store, root = _store(self.path)
        root = root.rstrip("/")
        parts, now, size = [], [], 0
        for entry in sorted(_listed(store, root), key=lambda e: e["name"]):
            if now and size + entry["size"] > self.partition_bytes:
                parts.append(Files(tuple(now)))
                now, size = [], 0
            now.append(entry["name"])
            size += entry["size"]
        return [*parts, Files(tuple(now))] if now else [Files(())]

    def wanted(self, row: dict) -> bool:
        return (all(row[c] is not None for c in self.present)
                and all(row[c] in values for c, values in self.tests))

    def read(self, partition):
        import pyarrow as pa
        kinds = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c.endswith("_length") else pa.string())
                           for c in COLUMNS])
        store, root = _store(self.path)
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_stream(f"{root}/{name}", compression=None) as raw:
                for row in records(raw, self.wanted, self.payload):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 400
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


class _Bytes:
    """Decompressed bytes of a file, member after member, or the bytes themselves."""

    def __init__(self, raw, chunk: int = 1 << 18):
        self.raw, self.chunk, self.buffer, self.at, self.over = raw, chunk, bytearray(), 0, False
        first = raw.read(chunk)
        self.unzip = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        self._take(first)

    def _take(self, data: bytes):
        if not data:
            self.over = True
        elif self.unzip is None:
            self.buffer += data
        else:
            while data:
                self.buffer += self.unzip.decompress(data)
                data = self.unzip.unused_data
                if self.unzip.eof:
                    self.unzip = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at > self.chunk:
            del self.buffer[:self.at]
            self.at = 0
        if not self.over:
            self._take(self.raw.read(self.chunk))
        return not self.over

    def until(self, mark: bytes) -> bytes | None:
        begin = self.at
        while (found := self.buffer.find(mark, begin)) < 0:
            left = len(self.buffer) - self.at
            if not self._more():
                return None
            begin = self.at + max(left - len(mark), 0)
        out = bytes(self.buffer[self.at:found])
        self.at = found + len(mark)
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        if len(self.buffer) - self.at < n:
            raise ValueError("WARC record is cut short")
        out = bytes(self.buffer[self.at:self.at + n])
        self.at += n
        return out

    def skip(self, n: int):
        while n > 0:
            here = min(n, len(self.buffer) - self.at)
            self.at += here
            n -= here
            if n and not self._more():
                raise ValueError("WARC record is cut short")


def records(raw, wanted, payload: bool = True):
    """Rows of a file. The header block is parsed first; ``wanted`` sees the header columns only."""
    data = _Bytes(raw)
    while (block := data.until(b"\r\n\r\n")) is not None:
        lines = block.lstrip(b"\r\n").decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head, key = {}, None
        for line in lines[1:]:
            if key and line[:1] in (" ", "\t"):
                head[key] += " " + line.strip()
                continue
            key, _, value = line.partition(":")
            key = key.strip().lower()
            head[key] = value.strip()
        length = int(head["content-length"])
        row = {c: head.get(h) for c, h in HEADERS.items()}
        row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
        row["content_length"] = length
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if not wanted(row):
            data.skip(length + 4)
            continue
        if payload:
            row["payload"] = data.exactly(length)
            if head.get("content-type", "").lower().startswith("application/http"):
                row["payload"] = row["payload"].partition(b"\r\n\r\n")[2] if b"\r\n\r\n" in row["payload"] else row["payload"]
        else:
            data.skip(length)
            row["payload"] = None
        data.skip(4)
        yield row


def clean_header(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(row: dict) -> bytes:
    body = row["payload"] or b""
    lines = ["WARC/1.1"]
    names = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
             "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_length": "X-Payload-Length"}
    for column, header in names.items():
        if row.get(column) is not None:
            lines.append(f"{header}: {clean_header(str(row[column]))}")
    if row.get("payload_digest"):
        lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row.get("record_type") == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, schema, overwrite=False):
        self.path, self.overwrite = options["path"], overwrite
        self.compress = str(options.get("compress", "true")).lower() == "true"

    def write(self, iterator):
        import uuid
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.compress else "")
        count = 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            size = 0
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record_bytes(row)
                    if self.compress:
                        z = zlib.compressobj(5, zlib.DEFLATED, 31)
                        data = z.compress(data) + z.flush()
                    out.write(data)
                    size += len(data)
                    count += 1
        return Written(name, count, size)

    def commit(self, messages):
        import uuid
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        replaces = sorted(_manifests(store, root)) if self.overwrite else []
        listed = [{"name": m.name, "records": m.records, "size": m.size} for m in messages if m and m.records]
        name = f"{MANIFEST}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{root}/{name}.new") as out:
            out.write(json.dumps({"files": listed, "replaces": replaces}).encode())
        store.move(f"{root}/{name}.new", f"{root}/{name}")

    def abort(self, messages):
        """Nothing to undo: files without a manifest are never read."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, id_col: str = "page_id", at_least: int = 1000) -> DataFrame:
    """``pages`` (id, payload binary) with payload_digest, payload_length, record_type, refers_to.

    Of records with equal payloads of at least ``at_least`` bytes the one with the largest id is the
    response, the others revisit it; shorter ones are all responses. The largest id per digest is a
    mergeable aggregate; only digests of several pages come back. Pages whose digest may be one of them (a filter of
    bounded size) are joined by digest, where adaptive execution splits a digest that many pages share; all other payloads stay where they are.
    """
    named = pages.withColumn("payload_digest", F.sha1("payload")).withColumn(
        "payload_length", F.octet_length("payload").cast("long"))
    large = named.where(F.col("payload_length") >= at_least)
    last = cut(large.groupBy("payload_digest").agg(F.max(id_col).alias("_last"), F.count(F.lit(1)).alias("_n"))
               .where("_n > 1").select("payload_digest", "_last"), "warc-last")
    shared = idfilter.build(last, "payload_digest")
    none = F.lit(None).cast(named.schema[id_col].dataType)
    if shared is None:
        joined = named.withColumn("_last", none)
    else:
        maybe = named.withColumn("_d", F.when(F.col("payload_length") >= at_least, F.col("payload_digest")))
        joined = (idfilter.matching(maybe, "_d", shared).join(last, "payload_digest", "left").select(*named.columns, "_last")
                  .unionByName(idfilter.matching(maybe, "_d", shared, keep=False).select(*named.columns, none.alias("_last"))))
    again = F.col("_last").isNotNull() & (F.col("payload_length") >= at_least) & ~F.col(id_col).eqNullSafe(F.col("_last"))
    return (joined.withColumn("record_type", F.when(again, F.lit("revisit")).otherwise(F.lit("response")))
            .withColumn("refers_to", F.when(again, F.col("_last"))).drop("_last"))


def archive(pages: DataFrame, path: str, id_col: str = "page_id", at_least: int = 1000,
            date: str = "2024-01-01T00:00:00Z", compress: bool = True, mode: str = "append") -> None:
    """Write one record per row of ``pages`` (page_id, url, html). A null html is an empty payload, a
    null id an empty record id. A revisit carries the digest and length of the payload, not its bytes."""
    register(pages.sparkSession)
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = with_revisits(pages.select(id_col, "url", body.alias("payload")), id_col, at_least)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    rows.select(urn(F.col(id_col)).alias("record_id"), "record_type", F.col("url").alias("target_uri"),
                F.lit(date).alias("warc_date"), F.when(F.col("refers_to").isNotNull(), urn(F.col("refers_to"))).alias("refers_to"),
                "payload_digest", "payload_length", F.octet_length("payload").cast("long").alias("content_length"),
                F.when(F.col("record_type") == "response", F.col("payload")).alias("payload")
                ).write.format("warc").option("path", path).option("compress", str(compress).lower()).mode(mode).save()


def read(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 32 << 20) -> DataFrame:
    register(spark)
    return (spark.read.format("warc").option("path", path).option("payload", str(payload).lower())
            .option("partition_bytes", str(partition_bytes)).load())


def page_id(urn: Column) -> Column:
    """The page id of a record id, null where there is none."""
    inner = F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)
    return F.when(inner != "", inner.cast("long"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages. Responses are
    measured on the payload that was read; revisits are read without decoding any payload."""
    responses = read(spark, path).where(F.col("record_type") == "response").select(
        page_id(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", page_id(F.col("refers_to")).alias("refers_to"))
    revisits = read(spark, path, payload=False).where(F.col("record_type") == "revisit").select(
        page_id(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        "payload_digest", "record_type", page_id(F.col("refers_to")).alias("refers_to"))
    return responses.unionByName(revisits)
