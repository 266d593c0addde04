"""WARC archives: a writer that replaces repeated payloads by revisits, and a splittable reader.

Writing: every record is one gzip member. Of records with equal payloads of ``min_revisit_bytes`` or
more, those with the largest id are responses and the others revisits that name it. Members go
through Spark's text sink, whose commit protocol leaves no half-written file behind when an executor
is lost and which writes to any store that Spark can write to. The sink ends every row with a
separator, so a row is a member without its last byte, and the separator is that byte: the top byte of
the member's length, 0 below 16 MiB. A longer record is followed by an empty member, whose top byte is 0.

Reading: files are cut into byte ranges. A task scans its range for gzip magic, takes a candidate as a
record when its first decoded bytes are a WARC version line and a whole header, and owns the records
that start inside its range; it reads past the end to finish the last. After a record the scan goes on
behind its last byte, so payload bytes that look like magic are passed over. Ranges are dealt one by one
over as many tasks as there are ranges, up to ``max_tasks``.

A member with a whole WARC header that can't be decoded to its end (cut off, or corrupt) is a row of type
``broken`` with its file and position and nulls elsewhere; the scan goes on one byte behind its start.
``on_broken="skip"`` leaves such rows out, ``"fail"`` raises. A member without a whole header is no record.

Defined results: a null payload is empty; a null URI leaves the URI header out; an id of null takes
part in no choice of the response except among nulls; repeated rows with the largest id are all
responses; archives without records give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
DATE = "2020-01-01T00:00:00Z"
ID_HEADER = "X-Record-Key"

RECORD = (
    "file string, position long, type string, target_uri string, record_id string, refers_to string, "
    "record_key string, refers_to_key string, payload_bytes long, payload_digest string, payload binary, digest_ok boolean"
)


def choose_responses(df: DataFrame, id_col: str, digest: Column, n_bytes: Column, min_bytes: int, salts: int = 16) -> DataFrame:
    """df with ``_response``: the largest id among equal long payloads, null where the row is a response itself.

    Repeated digests are pre-aggregated before the shuffle. As one digest may hold a third of all rows,
    the join deals each digest over ``salts`` parts.
    """
    x = df.withColumn("_digest", F.when(n_bytes >= min_bytes, digest)).withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    groups = x.filter(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.max(id_col).alias("_largest"), F.count("*").alias("_n"))
    groups = groups.filter("_n > 1 and _largest is not null").select(
        F.col("_digest").alias("_group"), "_largest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_part")
    )
    x = x.join(groups, (x["_digest"] == groups["_group"]) & (x["_salt"] == groups["_part"]), "left")
    revisits = F.col("_largest").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_largest"))
    return x.withColumn("_response", F.when(revisits, F.col("_largest"))).drop("_digest", "_salt", "_group", "_part", "_largest")


def record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(key))}>"


def member(key, uri: str | None, payload: bytes, refers_to, level: int = 6) -> bytes:
    """One gzip member: a response with the payload, or a revisit with the response's HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if uri is not None:
        headers.append(("WARC-Target-URI", "".join(uri.split("\r")).replace("\n", "")))
    if key is not None:
        headers.append((ID_HEADER, str(key)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), (f"{ID_HEADER}-Refers-To", str(refers_to))]
    block = http + (payload if refers_to is None else b"")
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))]).encode()
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(VERSION + head + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 1000
) -> None:
    """One archive file per task below ``path``."""
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    x = pages.select(pages[id_col].alias("key"), pages[uri_col].alias("uri"), payload.alias("payload"))
    x = choose_responses(x, "key", F.sha1("payload"), F.octet_length("payload"), min_revisit_bytes)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                made = [member(r["key"], r["uri"], r["payload"], r["_response"]) for r in rows]
                made = [m if m[-1] == 0 else m + EMPTY_MEMBER for m in made]
                yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary())], ["value"])

    encoded = x.select("key", "uri", "payload", "_response").mapInArrow(encode, "value binary")
    encoded.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def parse_header(data: bytes) -> tuple[dict[str, str], int] | None:
    """A record's headers in lower case, and where its block starts; None if data begins with no whole header."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines) if colon}
    return (headers, end + 4) if headers.get("content-length", "").isdigit() and "warc-type" in headers else None


class RangeScanner:
    """(position, member) of the records whose first byte lies in [start, end) of a seekable file; None for a broken member."""

    def __init__(self, file, start: int, end: int, block: int = 1 << 20, step: int = 1 << 16):
        self.file, self.start, self.end, self.block, self.step = file, start, end, block, step

    def _is_record(self, at: int) -> bool:
        """Whether a whole header stands here, however long: a member that begins like one is read to its blank line or end."""
        self.file.seek(at)
        unpack, seen = zlib.decompressobj(31), bytearray()
        while not unpack.eof:
            data = unpack.unconsumed_tail or self.file.read(8192 if seen else 512)
            if not data:
                break
            done = max(0, len(seen) - 3)
            try:
                seen += unpack.decompress(data, self.step)
            except zlib.error:
                return False
            if len(seen) >= 5 and not seen.startswith(b"WARC/"):
                return False
            if seen.find(b"\r\n\r\n", done) >= 0:
                return parse_header(bytes(seen)) is not None
        return False

    def _decode(self, at: int) -> tuple[bytes, int] | None:
        """The member at a position and the position behind it; None if it is broken."""
        self.file.seek(at)
        unpack, parts, read = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            data = self.file.read(1 << 16)
            if not data:
                return None
            read += len(data)
            try:
                parts.append(unpack.decompress(data))
            except zlib.error:
                return None
        return b"".join(parts), at + read - len(unpack.unused_data)

    def __iter__(self) -> Iterator[tuple[int, bytes | None]]:
        at = self.start
        while at < self.end:
            self.file.seek(at)
            data = self.file.read(min(self.block, self.end - at) + len(MAGIC) - 1)
            found = data.find(MAGIC)
            if found < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
                if len(data) < len(MAGIC):
                    return
                continue
            here = at + found
            if here >= self.end:
                return
            record = self._is_record(here)
            whole = self._decode(here) if record else None
            if record:
                yield here, whole[0] if whole else None
            at = whole[1] if whole else here + 1


def as_row(file: str, position: int, data: bytes | None) -> dict:
    if data is None:
        return dict.fromkeys(name.split()[0] for name in RECORD.split(", ")) | {"file": file, "position": position, "type": "broken"}
    headers, at = parse_header(data)
    block = data[at : at + int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if "application/http" in headers.get("content-type", "") else (b"", b"", block)
    digest = headers.get("warc-payload-digest", "").rpartition(":")[2]
    stated = base64.b32decode(digest).hex() if len(digest) == 32 else None
    lengths = [line.partition(b":")[2] for line in http.lower().split(b"\r\n") if line.startswith(b"content-length:")]
    row = {
        "file": file, "position": position, "type": headers["warc-type"], "target_uri": headers.get("warc-target-uri"),
        "record_id": headers.get("warc-record-id"), "refers_to": headers.get("warc-refers-to"),
        "record_key": headers.get(ID_HEADER.lower()), "refers_to_key": headers.get(f"{ID_HEADER.lower()}-refers-to"),
    }
    if row["type"] == "revisit":
        return row | {"payload_bytes": int(lengths[0]) if lengths else None, "payload_digest": stated, "payload": None, "digest_ok": None}
    own = hashlib.sha1(payload).hexdigest()
    return row | {"payload_bytes": len(payload), "payload_digest": own, "payload": payload, "digest_ok": stated == own if stated else None}


def ranges(spark: SparkSession, path: str, range_bytes: int, max_tasks: int = 20_000) -> DataFrame:
    """The byte ranges of the files below a path, one row each, dealt over the cluster.

    The number of parts is given, so adaptive execution, which goes by the few bytes of a range's row,
    doesn't join them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    starts = files.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))))
    x = starts.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end"))
    n = files.agg(F.sum(F.ceil(F.col("length") / F.lit(range_bytes)))).first()[0] or 1
    return x.repartition(min(int(n), max_tasks))


def read(spark: SparkSession, path: str, range_bytes: int = 32 << 20, with_payload: bool = True, on_broken: str = "row") -> DataFrame:
    """The records of the archives below ``path``; see RECORD for the columns."""
    if on_broken not in ("row", "skip", "fail"):
        raise ValueError(f"on_broken is row, skip or fail, not {on_broken}")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                uri = r["path"] if "://" in r["path"] else "file://" + r["path"].removeprefix("file:")
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as file:
                    for position, data in RangeScanner(file, r["start"], r["end"]):
                        if data is None and on_broken != "row":
                            if on_broken == "fail":
                                raise ValueError(f"broken record at {r['path']}:{position}")
                            continue
                        row = as_row(r["path"], position, data)
                        row["payload"] = row["payload"] if with_payload else None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges(spark, path, range_bytes).mapInArrow(scan, RECORD)
