"""WARC archives as a PySpark Python data source.

Writing: one gzip member a record; each member's header carries its own compressed and
full length (the ``sl`` extra field), so that a reader can step over a record without
inflating it.  A task starts a new file after ``file_bytes`` and notes a record-aligned
offset every ``chunk_bytes``; each commit writes these into a manifest of its own, so files
of failed or repeated tasks are never read.  An append adds a manifest; an overwrite
then drops the earlier ones and their files.

Reading: partitions are the chunks of all manifests, and whole files of other writers.  Equality, set,
prefix and length predicates on the record type and headers are pushed down: of each
record only the header is inflated and parsed first, and a record that the predicates
refuse is skipped by its length.  Payloads are inflated only if the requested schema has
``payload``.

Paths go through ``pyarrow.fs``, so file, HDFS and object-store URIs work.

Defined results: a null payload counts as empty; null ids are written as ``null`` and
come back as null, lowest in order; line breaks in header values become blanks; repeated
rows are repeated records; an empty table gives an archive without records.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .common import id_in, id_out, marker, new_path, stage

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, content_length long, payload binary"
TYPES = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload_digest": pa.string(), "payload_length": pa.int64(), "content_length": pa.int64(), "payload": pa.binary()}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of a batch that the reader hands over, and bytes of payload that end one early.
ROWS, BYTES = 512, 4 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


# --- records -----------------------------------------------------------------------

def _clean(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def record(row: dict, date: str) -> bytes:
    """One WARC record; the block is an HTTP response, of which a revisit keeps the header only."""
    payload = row.get("payload") or b""
    size = len(payload) if row.get("payload_length") is None else row["payload_length"]
    revisit = row["record_type"] == "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>", f"WARC-Date: {date}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row.get("payload_digest") is not None:
        lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_clean(row['refers_to'])}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    """A gzip member with its lengths in the ``sl`` extra field."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    size = 24 + len(body) + 8
    extra = b"sl\x08\x00" + size.to_bytes(4, "little") + len(raw).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


def parse_header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


# --- predicates --------------------------------------------------------------------

@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object

    def holds(self, row: dict) -> bool:
        v = row.get(self.column)
        if v is None:
            return False
        match self.op:
            case "eq":
                return v == self.value
            case "in":
                return v in self.value
            case "prefix":
                return v.startswith(self.value)
            case "gt":
                return v > self.value
            case "ge":
                return v >= self.value
            case "lt":
                return v < self.value
            case "le":
                return v <= self.value
        return True  # "set"


def as_predicate(f: ds.Filter) -> Predicate | None:
    """None for what Spark has to check itself."""
    kinds = {ds.EqualTo: "eq", ds.In: "in", ds.StringStartsWith: "prefix", ds.GreaterThan: "gt", ds.GreaterThanOrEqual: "ge", ds.LessThan: "lt", ds.LessThanOrEqual: "le", ds.IsNotNull: "set"}
    op = kinds.get(type(f))
    name = f.attribute[0] if op and len(f.attribute) == 1 else None
    if name not in TYPES or name == "payload":
        return None
    value = getattr(f, "value", None)
    return Predicate(name, op, frozenset(value) if op == "in" else value)


# --- reading -----------------------------------------------------------------------

#: Each commit leaves a manifest of its files; files of ours have these names.
MANIFEST, OWN_FILE = re.compile(r"_manifest-[0-9a-f]{32}\.json"), re.compile(r"part-[0-9a-f]{32}\.warc\.gz")


def _manifest(files, path: str) -> list[dict]:
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Chunk(ds.InputPartition):
    path: str
    start: int
    end: int | None


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.path = options["path"].rstrip("/")
        self.names = [f.name for f in schema.fields]
        self.predicates: list[Predicate] = []

    def pushFilters(self, filters):
        for f in filters:
            p = as_predicate(f)
            if p is None:
                yield f
            else:
                self.predicates.append(p)

    def partitions(self):
        from pyarrow import fs

        files, root = _fs(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(x.path[len(root) + 1 :] for x in found if x.type == fs.FileType.File)
        sizes = {x.path[len(root) + 1 :]: x.size for x in found}
        manifests = [n for n in names if MANIFEST.fullmatch(n)]
        own = [e for n in manifests for e in _manifest(files, f"{root}/{n}")]
        # with a manifest, files of ours that none lists were never committed
        other = [n for n in names if re.search(r"\.warc(\.gz)?$", n) and not (manifests and OWN_FILE.fullmatch(n))]
        chunks = [Chunk(f"{self.path}/{e['file']}", a, b) for e in own for a, b in zip(e["offsets"], [*e["offsets"][1:], e["size"]])]
        return chunks + [Chunk(f"{self.path}/{n}", 0, sizes[n]) for n in other]

    def read(self, partition):
        if partition is None:  # an archive without records has no partition
            return
        schema = pa.schema([(n, TYPES[n]) for n in self.names])
        rows: list[dict] = []
        size = 0
        for row in read_records(partition.path, partition.start, partition.end, "payload" in self.names, self.predicates):
            rows.append(row)
            size += len(row.get("payload") or b"")
            if len(rows) >= ROWS or size >= BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_records(path: str, start: int, end: int | None, payload: bool, predicates: list[Predicate]) -> Iterator[dict]:
    files, inner = _fs(path)
    with files.open_input_file(inner) as f:
        end = f.size() if end is None else end
        at = start
        while at < end:
            f.seek(at)
            lead = f.read(min(2048, end - at))
            if lead[:2] == b"\x1f\x8b":
                row, at = _gzip_record(f, at, end, lead, payload, predicates)
            else:
                row, at = _plain_record(f, at, lead, payload, predicates)
            if row is not None:
                yield row


def _columns(head: dict[str, str], http: bytes) -> dict:
    """Columns that need no payload."""
    digest = head.get("warc-payload-digest")
    size = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
    unbracket = lambda v: v[1:-1] if v and v.startswith("<") else v
    return {"record_id": unbracket(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "refers_to": unbracket(head.get("warc-refers-to")), "payload_digest": digest.removeprefix("sha256:") if digest else None, "payload_length": int(size[1]) if size else None, "content_length": int(head.get("content-length", 0))}


def _gzip_record(f, at: int, end: int, lead: bytes, payload: bool, predicates: list[Predicate]):
    body, size = 10, None
    if lead[3] & 4:
        extra = int.from_bytes(lead[10:12], "little")
        body = 12 + extra
        if lead[12:14] == b"sl":
            size = int.from_bytes(lead[16:20], "little")
    unpack = zlib.decompressobj(-15 if size else 31)
    src = lead[body:] if size else lead
    read_to = at + len(lead)
    text, rest = b"", src
    while (cut := text.find(b"\r\n\r\n")) < 0 or text.find(b"\r\n\r\n", cut + 4) < 0:  # the record's and the response's header
        if not rest and read_to < end and not unpack.eof:
            f.seek(read_to)
            rest = f.read(min(4096, end - read_to))
            read_to += len(rest)
        more = unpack.decompress(rest, 2048)
        rest = unpack.unconsumed_tail
        text += more
        if not more and (unpack.eof or not rest and read_to >= end):
            break
    head = parse_header(text[:cut] if cut >= 0 else text)
    split = text.find(b"\r\n\r\n", cut + 4)
    row = _columns(head, text[cut + 4 : split if split >= 0 else None])
    wanted = all(p.holds(row) for p in predicates)
    if wanted and payload or not size:
        parts = [text]
        if size:
            f.seek(read_to)
            parts.append(unpack.decompress(rest + f.read(max(0, at + size - read_to))))
        else:
            while not unpack.eof:
                if not rest:
                    f.seek(read_to)
                    rest = f.read(1 << 16)
                    read_to += len(rest)
                    if not rest:
                        break
                parts.append(unpack.decompress(rest) if wanted and payload else unpack.decompress(rest)[:0])
                rest = b""
            size = read_to - len(unpack.unused_data) - at
        if wanted and payload:
            block = b"".join(parts)[cut + 4 :][: row["content_length"]]
            row["payload"] = block.partition(b"\r\n\r\n")[2] if split >= 0 else block
    return (row if wanted else None), at + size


def _plain_record(f, at: int, lead: bytes, payload: bool, predicates: list[Predicate]):
    while (cut := lead.find(b"\r\n\r\n")) < 0:
        more = f.read(4096)
        if not more:
            return None, at + len(lead)
        lead += more
    head = parse_header(lead[:cut])
    size = int(head.get("content-length", 0))
    begin = at + cut + 4
    f.seek(begin)
    http = f.read(min(size, 2048)) if head.get("content-type", "").startswith("application/http") else b""
    row = _columns(head, http.partition(b"\r\n\r\n")[0])
    wanted = all(p.holds(row) for p in predicates)
    if wanted and payload:
        f.seek(begin)
        block = f.read(size)
        row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
    return (row if wanted else None), begin + size + 4


# --- writing -----------------------------------------------------------------------

@dataclass
class Written(ds.WriterCommitMessage):
    files: list


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.level = int(options.get("level", "6"))
        self.file_bytes, self.chunk_bytes = int(options.get("file_bytes", 1 << 30)), int(options.get("chunk_bytes", 16 << 20))

    def write(self, iterator):
        files, root = _fs(self.path)
        files.create_dir(root, recursive=True)
        done: list[dict] = []
        out = None
        for b in iterator:
            for row in b.to_pylist():
                if out is None:
                    done.append({"file": f"part-{uuid.uuid4().hex}.warc.gz", "offsets": [0], "size": 0})
                    out = files.open_output_stream(f"{root}/{done[-1]['file']}", compression=None)
                now = done[-1]
                if now["size"] - now["offsets"][-1] >= self.chunk_bytes:
                    now["offsets"].append(now["size"])
                raw = member(record(row, self.date), self.level)
                out.write(raw)
                now["size"] += len(raw)
                if now["size"] >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages):
        """Adds a manifest of this write's files; an overwrite then drops the manifests before it and their files."""
        from pyarrow import fs

        files, root = _fs(self.path)
        files.create_dir(root, recursive=True)
        before = [x.path for x in files.get_file_info(fs.FileSelector(root)) if MANIFEST.fullmatch(x.base_name)] if self.overwrite else []
        gone = [f"{root}/{e['file']}" for m in before for e in _manifest(files, m)]
        with files.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        for path in before + gone:
            files.delete_file(path)

    def abort(self, messages):
        files, root = _fs(self.path)
        for x in (x for m in messages if m for x in m.files):
            files.delete_file(f"{root}/{x['file']}")


class WarcDataSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives under ``path``; leave ``payload`` out of ``columns`` and no payload is inflated."""
    register(spark)
    if columns is None:
        return spark.read.format("warc").load(path)
    types = dict(x.split(" ") for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {types[c]}" for c in columns)).load(path)


#: Parts that a group of equal payloads is dealt into.
SALTS = 32


def crawl_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """WARC rows for pages: of equal payloads of ``min_bytes`` or more, the smallest id is the response.

    That is decided on ids, digests and lengths alone; the smallest id of a payload is found
    by partial minima and then met by (digest, salt), so a payload that a third of all pages
    share is dealt over ``SALTS`` tasks' worth of keys.  Payloads stay where they are, but for
    those that a bit map takes for revisits.
    """
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(id_in(pages[id_col]).alias("id"), (pages[url_col].cast("string") if url_col in pages.columns else F.lit(None).cast("string")).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    key = ["id", "payload_digest"]
    small = stage(rows.filter(F.col("payload_length") >= min_bytes).select(*key, F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")), "warc-digests")
    part = small.groupBy("payload_digest", "salt").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    whole = part.groupBy("payload_digest").agg(F.min("first").alias("response"), F.sum("n").alias("n")).filter("n > 1")
    first = part.select("payload_digest", "salt").join(whole.hint("shuffle_hash"), "payload_digest").select("payload_digest", "salt", "response")
    revisits = stage(small.join(first.hint("shuffle_hash"), ["payload_digest", "salt"]).filter("response < id").select(*key, "response").distinct(), "warc-revisits")
    rows = rows.withColumn("may", (F.col("payload_length") >= min_bytes) & marker(revisits, key)(*key))
    out = rows.filter("may").join(revisits.hint("shuffle_hash"), key, "left").unionByName(rows.filter("not may").withColumn("response", F.lit(None).cast("long")))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(id_out(c).cast("string"), F.lit("null")))
    revisit = F.coalesce(F.col("response") < F.col("id"), F.lit(False))
    return out.select(
        name("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, name("response")).alias("refers_to"), "payload_digest", "payload_length", F.lit(None).cast("long").alias("content_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_path(spark, "warc")
    crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    whole = read_warc(spark, path).filter("record_type = 'response'")
    heads = read_warc(spark, path, ["record_id", "record_type", "refers_to", "payload_digest", "payload_length"]).filter("record_type = 'revisit'")
    return whole.select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).unionByName(heads.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")))


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM q
"""
