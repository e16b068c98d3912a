"""Captures read in byte ranges, so that one large file is many tasks.

A capture has no index and its records no marks.  A range therefore *guesses*
where its first record starts: at the first offset from which a chain of
plausible headers leads on.  What makes the scan exact is the second step: the
record after a range's last one is where the next range must start, and the
first range starts at a known place.  Ranges whose guess differs from where the
range before leaves off are walked again from there, until all agree.  Reading
ends at the first damaged record, so ranges behind one are left out.

Ranges pass summaries (a row each) through a Spark table; packets are read in a
last step, block by block, so a task holds some MB whatever the file's size.
A task takes many ranges in a row where ranges are small and many: a file is
then opened once a task and its blocks are read once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .pcap import DDL, ENHANCED, INTERFACE, MOST, PCAP_BIG, PCAP_LITTLE, PCAPNG, SIMPLE, SNAPLEN, _fs

SPLIT_BYTES = 64 << 20
#: Up to so many ranges are a task each; of more, a task takes as many in a row as make up TASK_BYTES.
SIDE_BY_SIDE, TASK_BYTES = 100, 64 << 20
#: Bytes read at once (first and at most), and bytes of packets handed on at once.
FIRST_BYTES, BLOCK_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 10, 4 << 20, 4 << 20, 10_000
#: Headers in a row that make an offset plausible.
CHAIN = 6


class Bytes:
    """Random access to a file through one block in memory; blocks that follow one another double up to ``block``."""

    def __init__(self, file, size: int, block: int = BLOCK_BYTES):
        self.file, self.size, self.block = file, size, block
        self.begin, self.data, self.step = 0, b"", 0

    def at(self, place: int, n: int) -> bytes:
        """``n`` bytes from ``place`` on, fewer at the end."""
        o = place - self.begin
        if o < 0 or o + n > len(self.data):
            self.step = min(self.block, 2 * self.step if self.data and 0 <= o <= len(self.data) + self.step else FIRST_BYTES)
            self.file.seek(place)
            self.begin, self.data, o = place, self.file.read(min(max(n, self.step), max(0, self.size - place))), 0
        return self.data[o : o + n]


@dataclass
class Walk:
    """Where a walk over records stands: the next record, the link type in force, packets so far, and whether a damaged record ended it."""

    at: int
    link: int | None = None
    packets: int = 0
    damaged: bool = False


class Classic:
    """Records of the older format: a file header, then 16 bytes before each packet."""

    first = 24

    def __init__(self, src: Bytes, snaplen: bool = False):
        self.src = src
        order = ">" if src.at(0, 4) == PCAP_BIG else "<"
        self.head = struct.Struct(order + "IIII")
        self.whole = src.size >= 24
        allowed, link = struct.unpack_from(order + "II", src.at(0, 24), 16) if self.whole else (0, 0)
        self.most, self.link = min(allowed or SNAPLEN, MOST) if snaplen else MOST, link & 0xFFFF

    def walk(self, w: Walk, end: int) -> Iterator[tuple[float | None, int, int, int]]:
        """``(seconds, offset, bytes, link type)`` of the packets whose records start before ``end``."""
        w.damaged = not self.whole
        while w.at < end and not w.damaged:
            head = self.src.at(w.at, 16)
            sec, usec, size, _ = self.head.unpack(head) if len(head) == 16 else (0, 0, 0, 0)
            if not 0 < size <= self.most or w.at + 16 + size > self.src.size:
                w.damaged = True
                return
            start, w.at, w.packets = w.at + 16, w.at + 16 + size, w.packets + 1
            yield sec + usec / 1e6, start, size, self.link

    def plausible(self, at: int) -> int | None:
        """The next record, if one may start here."""
        head = self.src.at(at, 16)
        if len(head) < 16:
            return None
        _, usec, size, length = self.head.unpack(head)
        ok = 0 < size <= self.most and usec < 1_000_000 and size <= length <= 4 * MOST and at + 16 + size <= self.src.size
        return at + 16 + size if ok else None


class Blocks:
    """Records of the newer format: blocks with their length at both ends, in either byte order."""

    first = 0

    def __init__(self, src: Bytes):
        self.src = src

    def block(self, at: int) -> tuple[int, int] | None:
        """Type and length of the block, if it is whole."""
        head = self.src.at(at, 8)
        if len(head) < 8:
            return None
        kind, size = struct.unpack("<II", head)
        if not 12 <= size <= MOST:
            kind, size = struct.unpack(">II", head)
        if not 12 <= size <= MOST or at + size > self.src.size:
            return None
        tail = self.src.at(at + size - 4, 4) if size > self.src.block else self.src.at(at, size)[-4:]
        return (kind, size) if size in (int.from_bytes(tail, "little"), int.from_bytes(tail, "big")) else None

    def walk(self, w: Walk, end: int) -> Iterator[tuple[float | None, int, int, int | None]]:
        while w.at < end:
            if self.src.size - w.at < 12 or (found := self.block(w.at)) is None:
                w.damaged = True
                return
            (kind, size), start = found, w.at + 8
            body = self.src.at(start, min(20, size - 12))
            w.at += size
            if kind == INTERFACE and size >= 20:
                w.link = int.from_bytes(body[:2], "little")
            elif kind == ENHANCED and size >= 32:
                high, low, got = struct.unpack_from("<III", body, 4)
                if 0 < got <= min(MOST, size - 32):
                    w.packets += 1
                    yield ((high << 32) + low) / 1e6, start + 20, got, w.link
            elif kind == SIMPLE and size >= 16:
                got = min(int.from_bytes(body[:4], "little"), size - 16)
                if got > 0:
                    w.packets += 1
                    yield None, start + 4, got, w.link

    def plausible(self, at: int) -> int | None:
        found = self.block(at)
        return at + found[1] if found else None


def capture(src: Bytes, snaplen: bool = False) -> Classic | Blocks | None:
    """The file's format by its magic; other files hold no packets."""
    magic = src.at(0, 4)
    return Classic(src, snaplen) if magic in (PCAP_BIG, PCAP_LITTLE) else Blocks(src) if magic == PCAPNG else None


def first_record(records: Classic | Blocks, begin: int, end: int) -> int:
    """The first offset in the range from which CHAIN plausible records follow, or as many as lead to the file's end; else ``end``."""
    size = records.src.size
    for at in range(begin, end):
        nxt, n = at, 0
        while n < CHAIN and nxt < size:
            nxt, n = records.plausible(nxt), n + 1
            if nxt is None:
                break
        if nxt is not None:
            return at
    return end


def _summarise(snaplen: bool):
    """Walk every range from ``entry`` or, where that is null, from a guess."""
    return lambda batches: _summaries(batches, snaplen)


def _opened(batches, snaplen: bool):
    """Every range with the reader of its file, which ranges in a row share."""
    path, f, records = None, None, None
    try:
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != path:
                    if f is not None:
                        f.close()
                    fs, place = _fs(r["file"])
                    path, f = r["file"], fs.open_input_file(place)
                    records = capture(Bytes(f, r["length"]), snaplen)
                yield r, records
    finally:
        if f is not None:
            f.close()


def _summaries(batches, snaplen: bool):
    def out(rows):
        return pa.RecordBatch.from_pylist([dict(zip(_SUMMARY.names, x, strict=True)) for x in rows], _SUMMARY)

    rows = []
    for r, records in _opened(batches, snaplen):
        if records is None:
            rows.append((r["file"], r["length"], r["part"], r["begin"], r["end"], r["begin"], r["begin"], 0, None, True))
        else:
            entry = r["entry"]
            if entry is None:
                entry = records.first if r["part"] == 0 else first_record(records, r["begin"], r["end"])
            w = Walk(entry)
            for _ in records.walk(w, r["end"]):
                pass
            rows.append((r["file"], r["length"], r["part"], r["begin"], r["end"], entry, w.at, w.packets, w.link, w.damaged))
        if len(rows) == BATCH_ROWS:
            yield out(rows)
            rows = []
    if rows:
        yield out(rows)


_SUMMARY = pa.schema([("file", pa.string()), ("length", pa.int64()), ("part", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()), ("packets", pa.int64()), ("link", pa.int32()), ("damaged", pa.bool_())])
_RANGE = ["file", "length", "part", "begin", "end", "entry"]
_SUMMARY_DDL = "file string, length long, part int, begin long, end long, entry long, exit long, packets long, link int, damaged boolean"


def _dealt(ranges: DataFrame) -> DataFrame:
    """A task a range up to SIDE_BY_SIDE of them, else ranges in a row of TASK_BYTES together, in the order of their files."""
    n, held = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    n = max(1, min(n, 100_000, max(SIDE_BY_SIDE, -(-held // TASK_BYTES))))
    return ranges.repartitionByRange(n, "file", "part").sortWithinPartitions("file", "part")


def capture_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES, rounds: int = 1_000, snaplen: bool = False) -> DataFrame:
    """Ranges of ``files`` (``file``, ``length``) whose records join up, as summaries with ``first_no`` and ``link_before``.

    Ranges behind a damaged record are left out.  Every round walks the ranges
    whose entry was a wrong guess, all side by side.
    """
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / split_bytes) - 1, F.lit(0)).cast("int")))
    begin = F.col("part").cast("long") * split_bytes
    ranges = files.select("file", "length", part.alias("part")).withColumn("begin", begin).withColumn("end", F.least(begin + split_bytes, "length"))
    ranges = written(ranges.withColumn("entry", F.lit(None).cast("long")).select(_RANGE), "ranges")
    known = written(_dealt(ranges).mapInArrow(_summarise(snaplen), _SUMMARY_DDL), "summaries")
    by_file = Window.partitionBy("file").orderBy("part")
    for _ in range(rounds):
        # a record may reach over whole ranges, which then start and end behind themselves and hold none: the
        # furthest walk before a range carries over them in one round
        before, furthest = F.lag("exit").over(by_file), F.max("exit").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
        broken = F.coalesce(F.lag("damaged").over(by_file), F.lit(False))
        checked = known.withColumn("before", before).withColumn("furthest", furthest).withColumn("broken", broken)
        wrong = written(checked.where("before <> entry and not broken"), "wrong-guesses")
        if not wrong.limit(1).count():
            break
        again = _dealt(wrong.withColumn("entry", F.col("furthest")).select(_RANGE)).mapInArrow(_summarise(snaplen), _SUMMARY_DDL)
        known = written(known.join(wrong.select("file", "part"), ["file", "part"], "left_anti").unionByName(again), "summaries")
    else:
        raise RuntimeError(f"ranges did not join up in {rounds} rounds")
    upto = by_file.rowsBetween(Window.unboundedPreceding, -1)
    out = known.withColumn("_lost", F.coalesce(F.max(F.col("damaged").cast("int")).over(upto), F.lit(0)))
    out = out.withColumn("first_no", F.coalesce(F.sum("packets").over(upto), F.lit(0))).withColumn("link_before", F.last("link", ignorenulls=True).over(upto))
    return out.where("_lost = 0").drop("_lost")


def _read(snaplen: bool):
    return lambda batches: _packets(batches, snaplen)


def _packets(batches, snaplen: bool):
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.binary())

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "pkt_no", "ts", "linktype", "raw"])

    rows, size = [], 0
    for r, records in _opened(batches, snaplen):
        if records is None:
            continue
        file, number, src = r["file"], r["first_no"], records.src
        w = Walk(r["entry"], 1 if r["link_before"] is None else r["link_before"])
        for ts, start, n, link in records.walk(w, r["end"]):
            rows.append((file, number, ts, link, src.at(start, n)))
            number, size = number + 1, size + n
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield out(rows)
                rows, size = [], 0
    if rows:
        yield out(rows)


def scan_captures(spark, path: str, split_bytes: int = SPLIT_BYTES, glob: str = "*.pcap*", snaplen: bool = False) -> DataFrame:
    """Packets of all captures under ``path``, row for row those of the whole-file reader, from ranges of ``split_bytes`` each.

    Spark lists the files, tasks open them by range, so the store must be one
    that Arrow reaches (local or shared folders, HDFS, S3, GCS).  Files that are
    no captures, and empty ones, give no rows.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = listed.where("length > 0").select(F.col("path").alias("file"), "length")
    ranges = written(capture_ranges(files, split_bytes, snaplen=snaplen).where("packets > 0").select("file", "length", "part", "begin", "end", "entry", "first_no", "link_before"), "joined-ranges")
    return _dealt(ranges).mapInArrow(_read(snaplen), DDL)
