"""Deterministic sharded WARC writer and its reader.

Which records revisit which is settled on ids and digests alone.  Records are
cut into key ranges by deterministic bounds, sorted inside a range and streamed
by one task per range; their revisit marks are sorted in among them.  Every record is a gzip member of its own;
a file ends when its compressed size reaches the roll size.  All headers (ids,
dates, lengths, digests) are computed anew from the rows, so a rerun writes
the same bytes.  Tasks write under temporary names and report them as rows; a
manifest of the reported files is stored, and only listed files are renamed to
their final names.  What a lost or repeated task left behind is never listed.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs  # noqa: F401  pa.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, lean_batches, own_columns, range_bounds, shard_of, stash

ROLL_BYTES = 32 << 20
#: Raw payload bytes per key range, about: the unit of a writing task.
SHARD_BYTES = 32 << 20
MIN_REVISIT_BYTES = 1000
#: Fixed, so that a rerun writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
GZIP_LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def _field(value: str) -> str:
    """A header value: control characters (line ends above all) are percent-coded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(row: dict) -> bytes:
    """One WARC/1.1 record, uncompressed. ``row``: page_id, url, payload, digest, n_bytes, refers_to, refers_url."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    again = row["refers_to"] is not None
    block = http if again else http + row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {record_id(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"]:
        head.append(f"WARC-Target-URI: {_field(row['url'])}")
    if again:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"WARC-Refers-To-Date: {DATE}", f"Page-Refers-To: {row['refers_to']}"]
        if row["refers_url"]:
            head.append(f"WARC-Refers-To-Target-URI: {_field(row['refers_url'])}")
    head += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(row["digest"]).decode(),
        f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Page-Id: {'' if row['page_id'] is None else row['page_id']}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(root: str, roll: int):
    def write(batches):
        fs, path = filesystem(root)
        out, made = None, []
        state = {}

        def close():
            nonlocal out
            if out is not None:
                out.close()
                made.append(dict(state, sha256=state["sha256"].hexdigest()))
                out = None

        page, stands = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                # a page's revisits come just before its records
                if row["page_id"] != page:
                    page, stands = row["page_id"], {}
                if row["payload"] is None:
                    stands[row["digest"]] = (row["refers_to"], row["url"])
                    continue
                row["refers_to"], row["refers_url"] = stands.get(row["digest"], (None, None))
                if out is not None and (row["shard"] != state["shard"] or state["n_bytes"] >= roll):
                    close()
                if out is None:
                    number = made[-1]["number"] + 1 if made and made[-1]["shard"] == row["shard"] else 0
                    temp = f"_tmp-{row['shard']:05d}-{number:05d}-{os.urandom(8).hex()}"
                    state = {"shard": row["shard"], "number": number, "temp": temp, "n_records": 0, "n_bytes": 0, "sha256": hashlib.sha256()}
                    out = fs.open_output_stream(f"{path}/{temp}", compression=None)
                member = gzip_member(record(row))
                out.write(member)
                state["n_records"] += 1
                state["n_bytes"] += len(member)
                state["sha256"].update(member)
        close()
        if made:
            yield pa.RecordBatch.from_pylist([dict(m, file=f"part-{m['shard']:05d}-{m['number']:05d}.warc.gz") for m in made], schema=_FILES)

    return write


_FILES = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("temp", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
_FILES_DDL = "shard int, number int, file string, temp string, n_records long, n_bytes long, sha256 string"


def _commit(root: str):
    def commit(batches):
        fs, path = filesystem(root)
        for batch in batches:
            for r in batch.to_pylist():
                # repeatable: a second run finds the file in place
                if fs.get_file_info(f"{path}/{r['file']}").type == pa.fs.FileType.NotFound:
                    fs.move(f"{path}/{r['temp']}", f"{path}/{r['file']}")
            yield batch

    return commit


def revisits(prints: DataFrame) -> DataFrame:
    """``page_id``, ``digest``, ``refers_to`` and the url of that page (as ``url``), for every row that repeats another page's payload.

    ``prints`` has ``page_id``, ``url`` and ``digest``; payloads never take part.
    A digest's page is aggregated before it is joined back, so a hot digest's
    rows can be split.
    """
    named = prints.where("page_id is not null")
    firsts = named.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("first_url"))
    found = named.select("page_id", "digest").join(firsts, "digest").where("page_id <> refers_to")
    return found.select("page_id", "digest", "refers_to", F.col("first_url").alias("url"))


def write_warc(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> str:
    """Write one record per row in id order; returns the folder.

    Of records with equal payloads of at least 1000 bytes the one with the
    largest id is a response, the others revisit it.  Null html is an empty
    payload, a null url leaves the target header out, null ids come first and
    are always responses.  Rows that repeat an id are written each; copies that
    bear the largest id are responses.  An empty table gives an empty manifest.
    Other columns are ignored.
    """
    spark = pages.sparkSession
    lean_batches(spark)
    root = root or fresh_dir(spark, "warc")
    fs, path = filesystem(root)
    fs.create_dir(path, recursive=True)
    pages = own_columns(pages, page_id=id_col, url=url_col, html=html_col)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "n_bytes": F.octet_length("payload").cast("long")})
    prints = stash(rows.drop("payload"), "prints")
    bounds = range_bounds(prints.select("page_id", (F.col("n_bytes") + 300).alias("w")), "page_id", "w", shard_bytes)
    marks = revisits(prints.where(F.col("n_bytes") >= MIN_REVISIT_BYTES)).withColumns({"payload": F.lit(None).cast("binary"), "n_bytes": F.lit(0).cast("long")})
    # payloads move once, by range; what says that they are revisits meets them there
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks).withColumn("shard", shard_of("page_id", bounds).cast("int"))
    first = F.col("payload").isNotNull()
    ranged = both.repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), first, "url", "digest")
    written = stash(ranged.select("shard", "page_id", "url", "payload", "digest", "n_bytes", "refers_to").mapInArrow(_write(root, roll_bytes), _FILES_DDL), "warc-files")
    written.mapInArrow(_commit(root), _FILES_DDL).select("file", "n_records", "n_bytes", "sha256").write.parquet(f"{root}/manifest.parquet")
    return root


def _members(stream, size: int = 1 << 20):
    """Gzip members of a stream as bytes, holding one member and one buffer."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        chunk = rest or stream.read(size)
        rest = b""
        if not chunk:
            if parts:
                raise ValueError("truncated gzip member")
            return
        parts.append(z.decompress(chunk))
        if z.eof:
            yield b"".join(parts)
            z, parts, rest = zlib.decompressobj(31), [], z.unused_data


def _parse(raw: bytes) -> tuple[dict, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, block


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())])
_RECORDS_DDL = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def _read(root: str, with_payload: bool):
    def read(batches):
        fs, path = filesystem(root)
        for batch in batches:
            for f in batch.to_pylist():
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{path}/{f['file']}", compression=None) as stream:
                    for raw in _members(stream):
                        fields, block = _parse(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        kind = fields["WARC-Type"]
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                        page, refers = fields["Page-Id"], fields.get("Page-Refers-To")
                        rows.append({"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "payload": payload if with_payload and kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "file": f["file"]})
                        seen += 1
                        held += len(block) if with_payload else 0
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                            rows, held = [], 0
                if seen != f["n_records"]:
                    raise ValueError(f"{f['file']} holds {seen} records, the manifest says {f['n_records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return read


def read_warc(spark, root: str, with_payload: bool = True) -> DataFrame:
    """Records of all files in the manifest, digests verified; one task per file."""
    manifest = spark.read.parquet(f"{root}/manifest.parquet")
    return manifest.repartition(max(1, manifest.count()), "file").mapInArrow(_read(root, with_payload), _RECORDS_DDL)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    root = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(spark, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.keep IS NOT NULL AND p.page_id <> g.keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.keep IS NOT NULL AND p.page_id <> g.keep THEN g.keep END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000
"""
