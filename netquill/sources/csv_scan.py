"""CSV in byte ranges, UTF-8 or GB18030, every file with its own header.

A range owns the lines that start in it, so a file of any length is read by many
tasks in blocks of a few MB.  Neither encoding has the byte of a line break,
comma or quote inside a longer character, so files are cut before decoding.
Filters on the columns are answered by the source before rows reach Spark.
"""

from __future__ import annotations

import csv
import json
import re
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import pushed
from .pcap import _fs

#: Bytes of a task, and of what it holds at once (one line more, however long).
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
BREAK = re.compile(rb"\r\n|\n|\r(?!\n)")
MARK = b"\xef\xbb\xbf"
GB_MARK = b"\x84\x31\x95\x33"


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def listed(path: str) -> list[tuple[str, int]]:
    """Files and sizes under ``path``, in name order; hidden ones and those of a writer's bookkeeping are left out."""
    fs, root = _fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(root) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.size and not hidden(f.path))


def first_line(f) -> tuple[bytes, int]:
    """The header without its break, and where the next line starts."""
    f.seek(0)
    held = b""
    while True:
        more = f.read(1 << 16)
        held += more
        cut = BREAK.search(held)
        # a break at the very end of what is held may be half of one
        if cut and (cut.end() < len(held) or not more):
            return held[: cut.start()], cut.end()
        if not more:
            return held, len(held)


def blocks(f, begin: int, end: int, size: int, block: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The lines that start in ``[begin, end)``, whole, in pieces of about ``block`` bytes."""
    at = begin
    held = bytearray()
    if begin:
        # the line that reaches into the range belongs to the one before; a line that starts at ``begin`` does not
        f.seek(begin - 1)
        at = begin - 1
        while True:
            more = f.read(block)
            if not more:
                return
            cut = more.find(b"\n")
            at += len(more) if cut < 0 else cut + 1
            if cut >= 0:
                break
    if at >= end:
        return
    f.seek(at)
    start = at  # of what is held
    looked = 0
    while start < end:
        more = f.read(block)
        held += more
        if start + len(held) >= end:  # up to the break of the last line that starts before the end
            cut = held.find(b"\n", max(looked, end - 1 - start))
            if cut >= 0 or not more:
                yield bytes(held if cut < 0 else held[: cut + 1])
                return
        elif not more:
            yield bytes(held)
            return
        else:
            cut = held.rfind(b"\n", looked)
            if cut >= 0:
                yield bytes(held[: cut + 1])
                start += cut + 1
                del held[: cut + 1]
        looked = len(held)


def text_of(raw: bytes, encoding: str) -> str:
    """Decoded, what cannot be decoded replaced."""
    return raw.decode(encoding, "replace")


def names_of(header: bytes, encoding: str) -> list[str]:
    """Column names; a blank one is ``_c`` and its place, doubled ones have their place appended."""
    marks = MARK if encoding == "utf-8" else GB_MARK
    row = next(csv.reader([text_of(header.removeprefix(marks), encoding)]), [])
    row = [n.strip() for n in row]
    out: list[str] = []
    for i, n in enumerate(row):
        name = f"_c{i}" if not n else f"{n}{i}" if row.count(n) > 1 else n
        while name in out or (name != n and name in row):
            name += "_"
        out.append(name)
    return out


def _plain(raw: bytes) -> bool:
    """Whether every line closes its quotes and ends as one of the two usual ways."""
    b = np.frombuffer(raw, np.uint8)
    quotes = np.cumsum(b == 34)[b == 10]
    return not (quotes & 1).any() and raw.count(b"\r") == raw.count(b"\r\n")


def parsed(raw: bytes, names: list[str], wanted: list[str], encoding: str) -> pa.RecordBatch:
    """Text columns ``wanted`` of whole lines; null for an empty cell, a missing one and a column the file lacks.

    A record is a line.  Cells beyond the header are dropped; blank lines are no rows.
    """
    odd = not _plain(raw)
    if not odd:
        ragged: list[int] = []

        def skip(row):
            ragged.append(row.actual_columns)
            return "skip"

        data = raw if encoding == "utf-8" and _is_utf8(raw) else text_of(raw, encoding).encode()
        there = [c for c in wanted if c in names]
        table = data.strip() and pacsv.read_csv(
            pa.BufferReader(data),
            pacsv.ReadOptions(use_threads=False, column_names=names, block_size=max(len(data), 1) + 1),
            pacsv.ParseOptions(invalid_row_handler=skip),
            # a file of other columns still has rows: its first column counts them
            pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, include_columns=there or names[:1], null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False, check_utf8=False),
        )
        odd = bool(ragged)
    if odd:
        csv.field_size_limit(sys.maxsize)
        rows = []
        for line in BREAK.split(raw):
            if line:
                row = next(csv.reader([text_of(line, encoding)], quoting=csv.QUOTE_NOTNULL))
                rows.append((row + [None] * len(names))[: len(names)])
        table = pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(names)})
    n = table.num_rows if table else 0
    cells = [table.column(c).combine_chunks() if n and c in names else pa.nulls(n, pa.string()) for c in wanted]
    return pa.RecordBatch.from_arrays(cells, names=list(wanted))


class CsvReader(DataSourceReader):
    """Rows of all ranges for which the filters hold."""

    def __init__(self, options, schema):
        self.path, self.columns = options["path"], schema.names
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.block = int(options.get("blockBytes", BLOCK_BYTES))
        self.gb = set(json.loads(options.get("gb18030Files", "[]")))
        self.probe = options.get("probe") == "true"
        self.where = pushed.unpacked(options)
        # columns that are only filtered by are parsed, not returned
        self.parsed = list(dict.fromkeys([*self.columns, *(c for c, _, _ in self.where)]))

    def partitions(self):
        made = [Range(p, a, min(a + self.split, n)) for p, n in listed(self.path) for a in range(0, n, self.split)]
        return made or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = _fs(self.path)
        encoding = "gb18030" if partition.path in self.gb else "utf-8"
        with fs.open_input_file(partition.path) as f:
            pieces = lambda: blocks(f, partition.begin, partition.end, f.size(), self.block)
            if self.probe:
                yield pa.record_batch({"file": [partition.path], "utf8": [all(map(_is_utf8, pieces()))]})
                return
            header, after = first_line(f)
            names, at = names_of(header, encoding), partition.begin
            for raw in pieces():
                rest = raw[max(0, after - at) :] if at < after else raw
                at += len(raw)
                if rest and (batch := pushed.keep(self.where, parsed(rest, names, self.parsed, encoding))).num_rows:
                    yield batch.select(self.columns)


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


class CsvSource(DataSource):
    """Format ``text_csv``, all columns text.

    Options: ``columns`` (a JSON list; else those of all headers, in order of
    files), ``where`` (filters as :func:`pushed.packed` writes them),
    ``gb18030Files`` (a JSON list), ``splitBytes``, ``blockBytes``.
    """

    @classmethod
    def name(cls):
        return "text_csv"

    def schema(self):
        if self.options.get("probe") == "true":
            return "file string, utf8 boolean"
        if "columns" in self.options:
            names = json.loads(self.options["columns"])
        else:
            fs, _ = _fs(self.options["path"])
            gb = set(json.loads(self.options.get("gb18030Files", "[]")))

            def header(path):
                with fs.open_input_file(path) as f:
                    return names_of(first_line(f)[0], "gb18030" if path in gb else "utf-8")

            with ThreadPoolExecutor(16) as pool:
                names = list(dict.fromkeys(n for row in pool.map(header, [p for p, _ in listed(self.options["path"])]) for n in row))
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema):
        return CsvReader(self.options, schema)


def scan_csv(spark, path: str, columns=None, where=(), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All CSV files under ``path``: each in UTF-8, or in GB18030 if any of its lines is not UTF-8.

    One pass over the bytes settles the encodings; the driver gets the names of
    the files that are not UTF-8, as it holds the list of files in any case.
    Only ``columns`` and those of ``where`` are parsed, and only rows for which
    every ``(column, operator, value)`` of ``where`` is true reach Spark.  A column
    that a file lacks is null there.
    """
    spark.dataSource.register(CsvSource)
    source = lambda: spark.read.format("text_csv").option("splitBytes", split_bytes)
    odd = source().option("probe", "true").load(path).where("not utf8").select("file").distinct().collect()
    found = source().option("gb18030Files", json.dumps([r["file"] for r in odd])).option("where", pushed.packed(where))
    if columns:
        found = found.option("columns", json.dumps(list(columns)))
    return found.load(path)


def write_encoded_csv(df: DataFrame, path: str, encoding: str = "gb18030") -> None:
    """``df`` as CSV files with headers, in an encoding that Spark's writer lacks; ValueError for a value with a line break.

    A task writes one file under a temporary name; those of the attempts that
    counted are named when all tasks are done.
    """
    names = df.columns

    def write(batches):
        fs, root = _fs(path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.csv", 0
        with fs.open_output_stream(f"{root}/_temporary/{name}", compression=None) as out:
            head = pa.record_batch([pa.array([n]) for n in names], names=names)
            out.write(_csv_bytes(head).decode().encode(encoding))
            for b in batches:
                if any(pc.any(pc.match_substring_regex(c, r"[\r\n]")).as_py() for c in b.columns):
                    raise ValueError("a value holds a line break")
                out.write(_csv_bytes(b).decode().encode(encoding))
                rows += b.num_rows
        if rows:
            yield pa.record_batch({"name": [name]})

    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    done = sorted(r["name"] for r in text.mapInArrow(write, "name string").collect())  # a name a task
    fs, root = _fs(path)
    for i, name in enumerate(done):
        fs.move(f"{root}/_temporary/{name}", f"{root}/part-{i:05d}-{name}")


def _csv_bytes(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    pacsv.write_csv(batch, out, pacsv.WriteOptions(include_header=False))
    return out.getvalue().to_pybytes()
