"""Packet captures: reader, decoder, writer, and a Spark data source.

A capture has no index, so one file is one task; captures of any number are
read side by side.  ``spark.read.format("pcap")`` opens files with the Python
data source; :func:`read_packets` goes through Spark's own file listing and
also reaches stores that only Spark reads.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import PACKET
from . import headers, pushed

# File magics, block types, limits.
PCAP_BIG, PCAP_LITTLE, PCAPNG = b"\xa1\xb2\xc3\xd4", b"\xd4\xc3\xb2\xa1", b"\x0a\x0d\x0d\x0a"
INTERFACE, SIMPLE, ENHANCED = 1, 3, 6
MOST = 262144
#: What a header that states no limit allows.
SNAPLEN = 65535
# Fixed value: a common name inside a certificate (object id 2.5.4.3, then a string).
COMMON_NAME = re.compile(rb"\x06\x03\x55\x04\x03[\x0c\x13].([a-zA-Z0-9\-\.]{4,253})")

DDL = "file string, pkt_no long, ts double, linktype int, raw binary"


def packets(data: bytes, limit: int | None = None, snaplen: bool = False) -> Iterator[tuple[float | None, bytes, int]]:
    """``(seconds, bytes, link type)`` of a capture; reading ends at the first damaged record.

    With ``snaplen`` a record longer than the older format's header allows is damaged.

    Packets of simple blocks carry no time; theirs is null.
    """
    left = limit if limit is not None else -1
    for p in _classic(data, snaplen) if data[:4] in (PCAP_BIG, PCAP_LITTLE) else _blocks(data) if data[:4] == PCAPNG else ():
        if not left:
            return
        left -= 1
        yield p


def _classic(data: bytes, snaplen: bool = False):
    if len(data) < 24:
        return
    order = ">" if data[:4] == PCAP_BIG else "<"
    head = struct.Struct(order + "IIII")
    allowed, link = struct.unpack_from(order + "II", data, 16)
    most, link, at = min(allowed or SNAPLEN, MOST) if snaplen else MOST, link & 0xFFFF, 24
    while at + 16 <= len(data):
        sec, usec, size, _ = head.unpack_from(data, at)
        at += 16
        if not 0 < size <= most or at + size > len(data):
            return
        yield sec + usec / 1e6, data[at : at + size], link
        at += size


def _blocks(data: bytes):
    at, link = 0, 1
    while at + 12 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if not 12 <= size <= MOST:
            kind, size = struct.unpack_from(">II", data, at)
        if not 12 <= size <= MOST or at + size > len(data):
            return
        tail = data[at + size - 4 : at + size]
        if size not in (int.from_bytes(tail, "little"), int.from_bytes(tail, "big")):
            return
        body = data[at + 8 : at + size - 4]
        at += size
        if kind == INTERFACE and len(body) >= 8:
            link = int.from_bytes(body[:2], "little")
        elif kind == ENHANCED and len(body) >= 20:
            high, low, got = struct.unpack_from("<III", body, 4)
            if 0 < got <= min(MOST, len(body) - 20):
                yield ((high << 32) + low) / 1e6, body[20 : 20 + got], link
        elif kind == SIMPLE and len(body) >= 4:
            got = min(int.from_bytes(body[:4], "little"), len(body) - 4)
            if got > 0:
                yield None, body[4 : 4 + got], link


def capture_bytes(rows, linktype: int = 1) -> bytes:
    """A little-endian capture of ``(seconds, bytes)`` rows."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, linktype)]
    for ts, raw in rows:
        micros = round(ts * 1e6)
        out.append(struct.pack("<IIII", micros // 1_000_000, micros % 1_000_000, len(raw), len(raw)) + raw)
    return b"".join(out)


def record_bytes(ts: pa.Array, raw: pa.Array) -> pa.Buffer:
    """The records of :func:`capture_bytes`, from columns."""
    micros = np.rint(ts.fill_null(0.0).to_numpy(zero_copy_only=False) * 1e6)
    if raw.null_count or not ((micros >= 0) & (micros < 2**32 * 1e6)).all():
        raise ValueError("a packet without bytes, or at a time that a capture cannot hold")
    micros, head = micros.astype(np.int64), np.empty((len(raw), 4), "<u4")
    head[:, 0], head[:, 1] = micros // 1_000_000, micros % 1_000_000
    head[:, 2] = head[:, 3] = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    heads = pa.Array.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(head)]).cast(pa.binary())
    _, offsets, data = pc.binary_join_element_wise(heads, raw, b"").buffers()
    return data.slice(0, int(np.frombuffer(offsets, np.int32)[len(raw)]))


def valid_captures(files: DataFrame) -> DataFrame:
    """Rows of a ``binaryFile`` frame of 32 bytes or more that start with a known magic."""
    magic = F.hex(F.substring("content", 1, 4))
    return files.where((F.col("length") >= 32) & magic.isin(*[m.hex().upper() for m in (PCAP_BIG, PCAP_LITTLE, PCAPNG)]))


def label_of_path(path):
    """Class name a path mentions, benign otherwise."""
    from ..schemas import CLASS_LABELS

    out = F.lit("benign")
    for name in CLASS_LABELS[:0:-1]:
        out = F.when(F.lower(path).contains(name), name).otherwise(out)
    return out


def file_columns(df: DataFrame, path: str = "file") -> DataFrame:
    """Adds ``pcap_filename``, ``label`` and ``subset`` from the name ``<label>..._train.pcap``."""
    name = F.element_at(F.split(path, "/"), -1)
    subset = F.when(name.rlike(r"_train\.pcap(ng)?$"), "train").when(name.rlike(r"_test\.pcap(ng)?$"), "test")
    return df.withColumns({"pcap_filename": name, "label": label_of_path(F.col(path)), "subset": subset})


def _unpack(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = []
            for i, (ts, raw, link) in enumerate(packets(content or b"")):
                rows.append((path, i, ts, link, raw))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows):
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=PACKET.names)


def read_packets(spark, path: str, glob: str = "*.pcap*", recursive: bool = True) -> DataFrame:
    """Packets of all captures under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return valid_captures(files).select("path", "content").mapInArrow(_unpack, DDL)


def read_split_captures(spark, path: str) -> DataFrame:
    """Packets of the train and test captures under ``path`` with label, file name and subset."""
    return file_columns(read_packets(spark, path, "*_{train,test}.pcap*"))


# --- decoding


def decode(df: DataFrame, raw: str = "raw", probe: bool = False, ipv6: bool = False) -> DataFrame:
    """TCP and UDP packets with addresses, ports, flags and payload; everything else is left out.

    The IP header stands after the link header: 14 bytes for Ethernet, 16 for
    cooked captures, none else.  With ``probe`` the first of the offsets 14,
    16, 18 and 0 with a known version nibble is taken instead.  IPv4 only,
    unless ``ipv6``: then extension headers are followed and ``src_addr`` and
    ``dst_addr`` hold 128-bit addresses.  Columns of the added names are
    replaced.
    """
    added = "src_int long, src_ip string, dst_int long, dst_ip string, src_port int, dst_port int, protocol string, len int, fin boolean, syn boolean, rst boolean, psh boolean, ack boolean, payload binary"
    fields = T.StructType.fromDDL(added + (", src_addr binary, dst_addr binary" if ipv6 else ""))
    df = df.drop(*[f.name for f in fields])
    schema = T.StructType([*df.schema.fields, *fields])
    new, names = [f.name for f in fields], [f.name for f in schema]
    at_raw, at_link = df.columns.index(raw), df.columns.index("linktype") if "linktype" in df.columns else None

    def run(batches):
        for b in batches:
            link = np.zeros(b.num_rows, np.int64) if at_link is None else b.column(at_link).fill_null(0).to_numpy(zero_copy_only=False)
            keep, out = headers.decode_frames(b.column(at_raw), link, probe, ipv6)
            kept = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[out[n] for n in new]], names=names)

    return df.mapInArrow(run, schema)


def tls_packets(decoded: DataFrame) -> DataFrame:
    """TCP packets from or to port 443."""
    return decoded.where((F.col("protocol") == "tcp") & ((F.col("src_port") == 443) | (F.col("dst_port") == 443)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def common_names(payload: pd.Series) -> pd.Series:
    """Certificate common names in a payload, in order."""
    return payload.map(lambda b: [m.group(1).decode() for m in COMMON_NAME.finditer(b or b"")])


def certificates(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(names per packet, certificates)``: one row per name found, and per fingerprint its first sighting in the file.

    Validity is derived from the capture, as captures of this kind are
    summarised: from 30 days before to 365 days after the first sighting.
    """
    found = tls_packets(decoded).select("file", "pkt_no", "ts", F.posexplode(common_names("payload")).alias("pos", "cn")).withColumn("fp", F.sha2(F.col("cn").cast("binary"), 256))
    first = found.groupBy("file", "fp").agg(F.min_by(F.struct("cn", "ts"), F.struct("pkt_no", "pos")).alias("x"))
    days = 86400.0
    certs = first.select("file", "fp", F.concat(F.lit("CN="), "x.cn").alias("subject"), F.concat(F.lit("CN="), F.col("x.cn"), F.lit(" CA")).alias("issuer"), (F.col("x.ts") - 30 * days).alias("not_before"), (F.col("x.ts") + 365 * days).alias("not_after"), F.lit(2048).alias("key_length"))
    return found, certs


# --- sinks and the data source


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PcapReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options["limit"]) if "limit" in options else None
        self.where = pushed.unpacked(options)

    def partitions(self):
        """A file a task; files that a filter on ``file`` leaves out are not opened."""
        tests = pushed.tests_of(self.where, "file", pa.string())
        return [p for p in self._found() if all(t(p.path) for t in tests)] or [_Part("")]

    def _found(self):
        fs, path = _fs(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [_Part(path)]
        files = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return [_Part(f.path) for f in files if f.type == pafs.FileType.File and f.path.endswith((".pcap", ".pcapng"))] or [_Part("")]

    def read(self, partition):
        if partition.path:
            from .capture_scan import Bytes, Walk, capture

            fs, _ = _fs(self.path)
            with fs.open_input_file(partition.path) as f:  # block by block, however long
                src = Bytes(f, f.size())
                records = capture(src)
                if records is None:
                    return
                times, links = pushed.tests_of(self.where, "ts", pa.float64()), pushed.tests_of(self.where, "linktype", pa.int32())
                known: dict = {}  # a handful of link types
                for i, (ts, start, n, link) in enumerate(records.walk(Walk(records.first, 1), src.size)):
                    if self.limit is not None and i >= self.limit:
                        return
                    if link not in known:
                        known[link] = all(t(link) for t in links)
                    if known[link] and all(t(ts) for t in times):  # before the packet's bytes are read
                        yield partition.path, i, ts, link, src.at(start, n)


@dataclass
class _Written(WriterCommitMessage):
    """Temporary files of a task, each with the folder (below the sink's) and the name it is for."""

    files: list[tuple[str, str]]


#: Packets held for a file before they are written.
FLUSH_PACKETS = 100_000


def _folder(label, linktype: int | None) -> str:
    """Where packets of a label (null or absent: none) and link type go."""
    kind = {1: "ethernet", 113: "cooked"}.get(linktype, "raw" if linktype is None else f"raw-{linktype}")
    # letters, digits and dash stand for themselves: other characters would mean something in a path or its URI
    return kind if label is None else re.sub(r"[^A-Za-z0-9\-]", lambda m: f"_{ord(m[0]):x}_", f"{label}" or " ") + f"/{kind}"


class _Files:
    """A task's captures, one per label and link type; packets go out as they come, FLUSH_PACKETS at most are held."""

    def __init__(self, root: str, flush: int = FLUSH_PACKETS):
        self.fs, self.root = _fs(root)
        self.flush_at, self.held, self.number = flush, {}, 0
        self.open: dict[tuple, tuple] = {}

    def add(self, label, linktype, ts, raw: bytes) -> None:
        key = (label, linktype)
        self.held.setdefault(key, []).append((ts or 0.0, raw))
        self.number += 1
        if self.number >= self.flush_at:
            self.flush()

    def flush(self) -> None:
        for key, rows in self.held.items():
            label, linktype = key
            data = capture_bytes(rows, (linktype or 0) & 0xFFFF)
            if key not in self.open:
                self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
                name = f"{self.root}/_temporary/{uuid.uuid4().hex}.pcap"
                self.open[key] = (name, self.fs.open_output_stream(name, compression=None))
                self.open[key][1].write(data)
            else:
                self.open[key][1].write(data[24:])
        self.held, self.number = {}, 0

    def close(self) -> _Written:
        self.flush()
        for _, stream in self.open.values():
            stream.close()
        return _Written([(name, _folder(*key)) for key, (name, _) in sorted(self.open.items(), key=str)])


class _Sink:
    def __init__(self, options):
        self.path, self.flush = options["path"], int(options.get("flushPackets", FLUSH_PACKETS))

    def write(self, rows):
        out = _Files(self.path, self.flush)
        for r in rows:
            out.add(r["label"] if "label" in r else None, r["linktype"], r["ts"], bytes(r["raw"]))
        return out.close()

    def _discard(self, messages) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                if fs.get_file_info(name).type != pafs.FileType.NotFound:
                    fs.delete_file(name)

    def _place(self, messages, stem: str) -> list[str]:
        """Move temporary files to their folders, numbered in the order of tasks."""
        fs, root = _fs(self.path)
        done = []
        for i, (name, folder) in enumerate(f for m in messages if m for f in m.files):
            fs.create_dir(f"{root}/{folder}", recursive=True)
            done.append(f"{folder}/{stem}-{i:05d}.pcap")
            fs.move(name, f"{root}/{done[-1]}")
        return done


class PcapWriter(_Sink, DataSourceWriter):
    """Captures by label (where the frame has one) and link type, under temporary names until the job commits."""

    def commit(self, messages):
        self._place(messages, f"part-{uuid.uuid4().hex}")

    def abort(self, messages):
        self._discard(messages)


class PcapStreamWriter(_Sink, DataSourceStreamWriter):
    """The same for streams, every epoch once.

    An epoch is committed when its log ``_epochs/<number>.json`` stands, which
    names its files.  A repeated epoch whose log stands is dropped; one that was
    cut off before its log loses the files it had placed and is placed anew.
    """

    def commit(self, messages, batchId):
        fs, root = _fs(self.path)
        log = f"{root}/_epochs/{batchId}.json"
        if fs.get_file_info(log).type != pafs.FileType.NotFound:
            self._discard(messages)
            return
        stem = f"epoch-{batchId:010d}"
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
                if f.type == pafs.FileType.File and f.base_name.startswith(f"{stem}-"):
                    fs.delete_file(f.path)
        done = self._place(messages, stem)
        fs.create_dir(f"{root}/_epochs", recursive=True)
        half = f"{root}/_epochs/_{uuid.uuid4().hex}"
        with fs.open_output_stream(half, compression=None) as f:
            f.write(json.dumps(done).encode())
        fs.move(half, log)

    def abort(self, messages, batchId):
        self._discard(messages)


def committed_captures(path: str) -> list[str]:
    """Files of all committed epochs of a stream's sink."""
    fs, root = _fs(path)
    if fs.get_file_info(f"{root}/_epochs").type == pafs.FileType.NotFound:
        return []
    out = []
    for f in fs.get_file_info(pafs.FileSelector(f"{root}/_epochs")):
        if f.base_name.endswith(".json"):
            with fs.open_input_stream(f.path, compression=None) as s:
                out += [f"{root}/{x}" for x in json.loads(s.read())]
    return sorted(out)


_PIECE_DDL, _CAPTURE_DDL = "label string, linktype int, first long, last long, name string", "number int, label string, linktype int, names array<string>"


def _pieces(folder: str):
    """Writes a task's packets as compressed records without file header, one piece per label and link type."""

    def run(batches):
        fs, root = _fs(folder)
        found: dict[tuple, list] = {}  # name, stream, first and last number
        for b in batches:
            keys = pa.table([b["label"], b["linktype"]], names=["label", "linktype"])
            for key in keys.group_by(keys.column_names).aggregate([]).to_pylist():
                label, linktype = key["label"], key["linktype"]
                same = [pc.is_null(b[c]) if v is None else pc.fill_null(pc.equal(b[c], v), False) for c, v in key.items()]
                own = b.filter(pc.and_(*same))
                numbers = own["pkt_no"].to_numpy()
                if (label, linktype) not in found:
                    name = f"{root}/{uuid.uuid4().hex}.lz4"
                    found[label, linktype] = [name, fs.open_output_stream(name, compression="lz4"), int(numbers[0]), int(numbers[0])]
                piece = found[label, linktype]
                if numbers[0] < piece[3] or (np.diff(numbers) < 0).any():
                    raise ValueError(f"packets of {label} are not in order within a partition")
                piece[1].write(record_bytes(own["ts"], own["raw"].cast(pa.binary())))
                piece[3] = int(numbers[-1])
        for _, stream, *_ in found.values():
            stream.close()
        rows = [(*key, first, last, name) for key, (name, _, first, last) in found.items()]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["label", "linktype", "first", "last", "name"])

    return run


def _joined(folder: str, block: int = 4 << 20):
    """Writes each capture: a file header, then its pieces, block by block."""

    def run(batches):
        fs, root = _fs(folder)
        for b in batches:
            for r in b.to_pylist():
                name = f"{root}/{uuid.uuid4().hex}.pcap"
                with fs.open_output_stream(name, compression=None) as out:
                    out.write(capture_bytes([], (r["linktype"] or 0) & 0xFFFF))
                    for piece in r["names"]:
                        with fs.open_input_stream(piece, compression="lz4") as f:
                            while data := f.read(block):
                                out.write(data)
                yield pa.RecordBatch.from_pydict({"number": pa.array([r["number"]], pa.int32()), "name": [name]})

    return run


def write_in_order(df: DataFrame, path: str) -> None:
    """One capture per label and link type under ``path``, placed like those of the sink, packets by ``pkt_no``.

    ``df`` has ``label``, ``linktype``, ``pkt_no``, ``ts`` and ``raw``; a partition holds numbers of a label
    in order and no other partition has any between them, as a sort by range leaves them (ValueError else).
    Tasks write their packets side by side as pieces; then a task a capture joins its pieces.  Only the
    pieces' names come to the driver.
    """
    fs, _ = _fs(path)
    held = f"{path}/_temporary/{uuid.uuid4().hex}"
    fs.create_dir(_fs(held)[1], recursive=True)
    of: dict[tuple, list] = {}
    try:
        for p in df.select("label", "linktype", "pkt_no", "ts", "raw").mapInArrow(_pieces(held), _PIECE_DDL).collect():
            of.setdefault((p["label"], p["linktype"]), []).append((p["first"], p["last"], p["name"]))
        rows = []
        for (label, linktype), pieces in sorted(of.items(), key=str):
            pieces.sort()
            if any(a[1] > b[0] for a, b in zip(pieces, pieces[1:], strict=False)):
                raise ValueError(f"packets of {label} are not in order over partitions")
            rows.append((len(rows), label, linktype, [name for _, _, name in pieces]))
        if rows:
            captures = df.sparkSession.createDataFrame(rows, _CAPTURE_DDL).repartitionByRange(len(rows), "number")
            joined = sorted(captures.mapInArrow(_joined(held), "number int, name string").collect())
            files = [(r["name"], _folder(*rows[r["number"]][1:3])) for r in joined]
            _Sink({"path": path})._place([_Written(files)], f"part-{uuid.uuid4().hex}")
    finally:
        fs.delete_dir(_fs(held)[1])


class PcapSource(DataSource):
    """``spark.dataSource.register(PcapSource)``, then format ``pcap``.

    Options: ``limit``, packets per file, counted before filters; ``where``,
    filters on ``file``, ``ts`` and ``linktype`` as :func:`pushed.packed` writes them.
    """

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return PACKET

    def reader(self, schema):
        return PcapReader(self.options)

    def writer(self, schema, overwrite):
        return PcapWriter(self.options)

    def streamWriter(self, schema, overwrite):
        return PcapStreamWriter(self.options)


def open_captures(spark, path: str, where=()) -> DataFrame:
    """Packets of all captures under ``path``; ``where`` filters by file, time and link type before packets are read."""
    spark.dataSource.register(PcapSource)
    return spark.read.format("pcap").option("where", pushed.packed(where, ("file", "ts", "linktype"))).load(path)


def _fs(path: str):
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
