"""WARC archives: a deterministic sharded writer and a streaming reader.

Records are dealt by exact ranges of their id and sorted, so that the same rows give the same files byte for byte,
whatever the cluster. A task writes each file under a temporary name and renames it when it is whole; a task that is
run again writes the same file over it. The manifest, written last and by Spark's own commit, names the files that
count. Every record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import dealt, numbered_ranges, small_side, written

#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 1000
_SPACE = uuid.UUID("8c2f63f4-0f0f-5b6a-9d4e-2f1f6c1f7a11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, ordinal: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{ordinal}')}>"


def header_url(url: str | None, page_id: int | None) -> str:
    """The URL in one line: control characters and blanks are percent-encoded; without one, a name from the id."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str, ordinal: int = 0) -> bytes:
    """One record: a response with its payload, or a revisit (refers_to: the response's page id) without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, ordinal)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_url(url, page_id)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {sha1_label(payload)}",
        f"WARC-Block-Digest: {sha1_label(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, 0)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Writes records to files of one shard, a new one when the compressed size is reached."""

    def __init__(self, store, base: str, shard: int, limit: int):
        self.store, self.base, self.shard, self.limit = store, base, shard, limit
        self.number, self.out, self.done = 0, None, []

    def add(self, page_id, data: bytes) -> None:
        if self.out is not None and self.size + len(data) > self.limit and self.records:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary/{uuid.uuid4().hex}-{self.name}"
            self.out, self.sum, self.size, self.records = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.store.move(self.temporary, f"{self.base}/{self.name}")
        self.done.append((self.name, self.shard, self.number, self.records, self.size, self.sum.hexdigest()))
        self.out, self.number = None, self.number + 1


def keepers(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """sum, keeper: of each payload of enough bytes that several rows have, the greatest id."""
    p = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    big = pages.select(F.col(id_col).alias("i"), p.alias("p")).where(F.octet_length("p") >= least).select("i", F.sha2("p", 256).alias("sum"))
    return big.groupBy("sum").agg(F.max("i").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("sum", "keeper")


def write_archives(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = 16 << 20, file_bytes: int = 16 << 20, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes every row as a record under `out` (a folder all executors reach) and returns the manifest.

    Of equal payloads of at least 1000 bytes, the row of greatest id is a response and others revisit it (all rows of
    that id are responses); smaller ones are responses. A null payload is empty, a null id comes first and has no id
    header; repeated rows are records each; an empty table gives an empty manifest; other columns are left out.
    Manifest: file, shard, number, records, bytes (compressed), sha256.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"), payload.alias("__payload"))
    size = src.agg(F.sum(F.octet_length("__payload"))).first()[0] or 0
    src, shards = numbered_ranges(src, "__id", max(1, -(-size // shard_bytes)), "__shard")
    same = written(keepers(src, "__id", "__payload"), "keepers")
    # payloads that no other revisits have keys of their own, so that they spread where the join shuffles
    alone = F.concat(F.lit("~"), F.coalesce(F.col("__id").cast("string"), F.lit("")))
    marked = src.withColumn("__sum", F.when(F.octet_length("__payload") >= LEAST_REVISIT, F.sha2("__payload", 256)).otherwise(alone)).join(small_side(same, same.count()), F.col("__sum") == F.col("sum"), "left")
    ordered = marked.select("__id", "__url", "__payload", F.when(~F.col("__id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("__refers"), "__shard")
    ordered = dealt(ordered, "__shard", shards).sortWithinPartitions("__shard", "__id", "__url", "__payload")
    store, base = fs.FileSystem.from_uri(out)
    store.create_dir(f"{base}/_temporary", recursive=True)

    def run(batches):
        store, base = fs.FileSystem.from_uri(out)
        roller, last, ordinal, done = None, None, 0, []
        for b in batches:
            cols = [b.column(c) for c in ("__id", "__url", "__payload", "__refers", "__shard")]
            for i in range(b.num_rows):
                page_id, url, text, refers, shard = (c[i].as_py() for c in cols)
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = _Roller(store, base, shard, file_bytes)
                ordinal = ordinal + 1 if last == (shard, page_id) else 0
                last = (shard, page_id)
                roller.add(page_id, _gzip(record(page_id, url, text.encode("utf-8", "surrogatepass"), refers, date, ordinal), level))
        if roller is not None:
            roller.close()
            done += roller.done
        names = ["file", "shard", "number", "records", "bytes", "sha256"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=pa.schema([("file", pa.string()), ("shard", pa.int32()), ("number", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    manifest = ordered.mapInArrow(run, "file string, shard int, number int, records long, bytes long, sha256 string")
    # a task for each shard: merged partitions above the map would merge the writing itself, so the small table is compacted once it is written
    manifest.write.mode("overwrite").parquet(f"{out}/_temporary/manifest")
    spark.read.parquet(f"{out}/_temporary/manifest").coalesce(max(1, shards // 64)).write.mode("overwrite").parquet(f"{out}/_manifest")
    store.delete_dir(f"{base}/_temporary")
    return spark.read.parquet(f"{out}/_manifest")


def _members(stream, chunk: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and its block."""
    head, rest = member.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block


def read_archives(spark: SparkSession, out: str, payloads: bool = True, files_a_task: int = 4) -> DataFrame:
    """The records of the files in the manifest: page_id, record_id, record_type, target_uri, refers_to_id,
    payload_bytes and payload_digest (hex SHA-1) of the full payload, and the payload of responses if asked for.

    Block and payload digests are checked against the bytes, files against the manifest's lengths.
    """
    listed = spark.read.parquet(f"{out}/_manifest").select("file", "bytes")
    n = listed.count()
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string())])
    if not payloads:
        schema = schema.remove(schema.get_field_index("payload"))

    def run(batches):
        store, base = fs.FileSystem.from_uri(out)
        rows, held = [], 0
        for b in batches:
            for name, size in zip(b.column("file").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                if store.get_file_info(f"{base}/{name}").size != size:
                    raise ValueError(f"{name} is not as the manifest has it")
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        h, block = parse(member)
                        http, payload = block.split(b"\r\n\r\n", 1)
                        if sha1_label(block) != h["warc-block-digest"]:
                            raise ValueError(f"a block of {name} has another digest")
                        full = int(http.lower().split(b"content-length:", 1)[1].split(b"\r\n", 1)[0])
                        response = h["warc-type"] == "response"
                        if response and (len(payload) != full or sha1_label(payload) != h["warc-payload-digest"]):
                            raise ValueError(f"a payload of {name} has another digest")
                        row = {
                            "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
                            "record_id": h["warc-record-id"],
                            "record_type": h["warc-type"],
                            "target_uri": h["warc-target-uri"],
                            "refers_to_id": h.get("warc-refers-to"),
                            "payload_bytes": full,
                            "payload_digest": base64.b32decode(h["warc-payload-digest"][5:]).hex(),
                        }
                        if payloads:
                            row["payload"] = payload.decode("utf-8", "surrogatepass") if response else None
                        rows.append(row)
                        held += len(payload) if payloads else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    fields = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
    tasks = max(1, -(-n // files_a_task)) if n > 256 else max(1, n)
    return listed.repartition(tasks, "file").mapInArrow(run, fields)


def archive_round_trip(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", **options) -> DataFrame:
    """Writes pages and reads the archives back.

    Returns id_col, payload_bytes, payload_digest, record_type and refers_to (the page a revisit's record id leads to;
    else null), one row for each record.
    """
    write_archives(pages, out, id_col, url_col, payload_col, **options)
    records = read_archives(pages.sparkSession, out, payloads=False)
    records = written(records, "records")
    wanted = records.where("refers_to_id is not null")
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("__r"), F.col("page_id").alias("refers_to")).distinct()
    found = wanted.select(F.col("refers_to_id").alias("__r")).distinct().join(responses, "__r")
    found = written(found, "found")
    to = F.coalesce("refers_to_id", F.concat(F.lit("~"), "record_id"))
    joined = records.join(small_side(found, found.count()), to == F.col("__r"), "left")
    return joined.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
