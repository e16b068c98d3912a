"""Token-id output: one zstandard frame per document with a shared, trained dictionary.

Layout of a store (a folder):

* ``dictionary.zdict``: dictionary trained on serialized id arrays,
* ``shard-00000-<hash>.tok``: the documents' frames, one after another,
* ``shard-00000-<hash>.idx``: per document id, byte offset and id count,
* ``manifest.parquet``: per shard its files, sizes, and the ids before it.

A frame holds a document's ids as little-endian uint32.  Every index carries
the SHA-256 of the dictionary, so a reader cannot use another one.  A short
document is one index lookup, one ranged read and one small frame.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, lean_batches, own_columns, range_bounds, shard_of, trim
from .repeats import _SPACE

END_ID = 2
#: Pieces whose ids a worker keeps, in each of two generations; when the younger is full the elder goes.
MEMO_PIECES = 150_000
#: Text that is encoded at once.
PART_BYTES = 4 << 20
#: The dictionary is for short documents: it is trained on whole texts of at most DICT_CHARS characters, the first in md5 order of id and text, at most so many and of so many bytes.
DICT_DOCS, DICT_CHARS, DICT_BYTES, DICT_SIZE = 2_000, 20_000, 4 << 20, 64 << 10
SHARD_BYTES = 24 << 20

# What the fast path below assumes of a tokenizer's file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

#: Words of printable ASCII and Latin-1 letters: there lower-casing and composition touch single characters only.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: The tokenizer's own pattern, written out for lower-cased plain words with a space between them.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, others for letters from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer's file normalises and cuts texts as the fast path does.

    Its pattern must never cross white space, its normalizers must leave the cut
    at ASCII white space alone, and its added tokens must be such that words
    with ``<|`` cover them.
    """
    with open(path) as f:
        spec = json.load(f)
    whole = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and spec.get("truncation") is None
    cut = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    return whole and cut and all("<|" in t["content"] and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])


class Memo:
    """A bounded dictionary of two generations: what is used again moves to the younger one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def find(self, keys: list, make) -> list:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for k in keys:
            if k not in young:
                found = old.get(k)
                if found is None:
                    new.append(k)
                else:
                    young[k] = found
        young.update(zip(new, make(new), strict=True))
        return [young[k] for k in keys]


def _gather(flat: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The stretches ``first, many`` of ``flat`` in a row."""
    before = np.cumsum(many) - many
    return flat[np.repeat(first - before, many) + np.arange(int(many.sum()))]


def _packed(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id arrays one after another, where each starts, and how many ids it has."""
    many = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return np.frombuffer(b"".join(found), np.uint32), np.cumsum(many) - many, many


def _objects(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """``encode(text, add_special_tokens=False).ids`` of many texts at once.

    Where the tokenizer cuts at spaces (:func:`cuts_at_spaces`) a text's ids
    are its words' ids in a row.  The words of all texts are one Arrow column,
    and only its distinct values are looked at.  Plain words are cut into the
    pattern's pieces, distinct pieces go to the model directly, and all ids are
    gathered from theirs; any other word goes through the whole tokenizer.
    Texts of any other tokenizer go through it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), cuts_at_spaces(path)
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.pieces, self.odd = Memo(MEMO_PIECES), Memo(MEMO_PIECES // 10)

    def _model_ids(self, pieces: list[str]) -> list[bytes]:
        letters, tokenize = self.letters, self.model.tokenize
        names = [x if x.isascii() else "".join([letters[b] for b in x.encode()]) for x in pieces]
        return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in names]

    def _whole_ids(self, words: list[str]) -> list[bytes]:
        parts = [words[i : i + 2_000] for i in range(0, len(words), 2_000)]
        return [array("I", e.ids).tobytes() for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _plain_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words in a row, and their number per word."""
        if not len(words):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")[0].as_py().lower()
        pieces = pa.array(_PIECES.findall(text), pa.string())
        # pieces leave no character out, so their lengths tell whose they are
        ends = np.cumsum(pc.utf8_length(words).to_numpy())
        owner = np.searchsorted(ends, np.cumsum(pc.utf8_length(pieces).to_numpy()))
        pieces = pieces.dictionary_encode()
        number = pieces.indices.to_numpy()
        flat, first, many = _packed(self.pieces.find(_objects(pieces.dictionary), self._model_ids))
        n = many[number]
        return _gather(flat, first[number], n), np.bincount(owner, n, len(words)).astype(np.int64)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, size = edge[::2], edge[1::2] - edge[::2]
        if not len(size):
            return [np.empty(0, np.uint32) for _ in texts]
        ends = np.concatenate([[0], np.cumsum(size)])
        words = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[~space])]).dictionary_encode()
        distinct, number = words.dictionary, words.indices.to_numpy()
        plain = pc.and_not(pc.match_substring_regex(distinct, _PLAIN), pc.match_substring(distinct, "<|"))
        flat, n = self._plain_ids(distinct.filter(plain))
        odd, odd_first, odd_many = _packed(self.odd.find(_objects(distinct.filter(pc.invert(plain))), self._whole_ids))
        plain = plain.to_numpy(zero_copy_only=False)
        first, many = np.empty(len(plain), np.int64), np.empty(len(plain), np.int64)
        first[plain], many[plain] = np.cumsum(n) - n, n
        first[~plain], many[~plain] = odd_first + len(flat), odd_many
        n = many[number]
        ids = _gather(np.concatenate([flat, odd]), first[number], n)
        before = np.concatenate([[0], np.cumsum(n)])
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = before[np.searchsorted(start, begin)].tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and tokenizer; later tasks find its memo filled."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def dictionary_sample(docs: DataFrame) -> list[str]:
    """The first DICT_DOCS short texts in md5 order of id and text; rows equal in both count once.

    Only rows in a leading share of the md5 range are sorted.  The share is
    made to hold four times the rows that are asked for, and widened until it
    holds enough or is the whole, so the sample is that of a full sort but no
    task receives some rows of every other.
    """
    short = docs.where(F.length("text") <= DICT_CHARS)
    share = min(1.0, 4 * DICT_DOCS / max(1, short.count()))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    placed = short.select(order.alias("order"), "text")
    while True:
        lead = placed.where(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") < F.lit(math.ceil(share * 2**32)))
        found = lead.groupBy("order").agg(F.min("text").alias("text")).orderBy("order").limit(DICT_DOCS).collect()
        if len(found) == DICT_DOCS or share >= 1:
            return [r.text for r in found]
        share = min(1.0, 4 * share)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Dictionary content from a bounded sample of short documents (see :data:`DICT_DOCS`); empty if it is too small to train on."""
    samples, size = [], 0
    encode = WordEncoder(tokenizer)
    for text in dictionary_sample(docs):
        ids = encode([text.encode()])[0]
        samples.append(ids.astype("<u4").tobytes())
        size += len(samples[-1])
        if size > DICT_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(DICT_SIZE, max(1024, size // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(content: bytes):
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content) if content else None, write_content_size=True)


def _decompressor(content: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)


def _parts(batches, limit: int = PART_BYTES):
    """Rows of one shard at a time: ``(shard, ids, texts)`` of about ``limit`` bytes."""
    shard, ids, texts, size = None, [], [], 0
    for batch in batches:
        for s, i, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if texts and (s != shard or size >= limit):
                yield shard, ids, texts
                ids, texts, size = [], [], 0
            shard = s
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield shard, ids, texts


class _Shard:
    """A shard in the making: frames go out as they come, only the index is kept."""

    def __init__(self, fs, path: str, number: int):
        self.fs, self.path, self.number = fs, path, number
        self.temp = f"{path}/_tmp-{number:05d}-{os.urandom(8).hex()}"
        self.out, self.digest, self.at = fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0
        self.ids, self.offsets, self.counts = [], [], []

    def add(self, doc_id, frame: bytes, n_ids: int) -> None:
        self.ids.append(doc_id)
        self.offsets.append(self.at)
        self.counts.append(n_ids)
        self.at += self.out.write(frame)
        self.digest.update(frame)

    def close(self, dictionary: str) -> dict:
        self.out.close()
        # content in the name: a retried task writes the same file, a torn one is never listed
        name = f"shard-{self.number:05d}-{self.digest.hexdigest()[:16]}"
        index = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "offset": pa.array(self.offsets, pa.int64()), "n_ids": pa.array(self.counts, pa.int64())})
        index = index.replace_schema_metadata({"dictionary": dictionary, "end": str(self.at)})
        with self.fs.open_output_stream(f"{self.temp}.idx", compression=None) as f, ipc.new_file(f, index.schema) as w:
            w.write_table(index)
        self.fs.move(self.temp, f"{self.path}/{name}.tok")
        self.fs.move(f"{self.temp}.idx", f"{self.path}/{name}.idx")
        known = [i for i in self.ids if i is not None]
        return {"shard": self.number, "file": name, "n_docs": len(self.ids), "n_ids": sum(self.counts), "n_bytes": self.at, "has_null": len(known) < len(self.ids), "first_id": min(known, default=None), "last_id": max(known, default=None)}


_WRITTEN = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("has_null", pa.bool_()), ("first_id", pa.int64()), ("last_id", pa.int64())])
_WRITTEN_DDL = "shard long, file string, n_docs long, n_ids long, n_bytes long, has_null boolean, first_id long, last_id long"


def _write(root: str, tokenizer: str, end_id: int):
    def write(batches):
        trim()
        fs, path = filesystem(root)
        with fs.open_input_file(f"{path}/dictionary.zdict") as f:
            content = f.read()
        encode, press, key = encoder(tokenizer), _compressor(content), hashlib.sha256(content).hexdigest()
        made, end, done = None, np.array([end_id], "<u4").tobytes(), []
        for shard, ids, texts in _parts(batches):
            if made is not None and made.number != shard:
                done.append(made.close(key))
                made = None
            made = made or _Shard(fs, path, shard)
            for doc_id, found in zip(ids, encode(texts), strict=True):
                made.add(doc_id, press.compress(found.astype("<u4", copy=False).tobytes() + end), len(found) + 1)
        if made is not None:
            done.append(made.close(key))
        trim()
        yield pa.RecordBatch.from_pylist(done, schema=_WRITTEN)

    return write


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", root: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> str:
    """Write a token store in ascending id order and return its folder.

    Rows are dealt to key ranges, sorted inside them, and every range is
    streamed to one shard, whatever its size.  Null text is empty: its document
    is the end id alone.  Null ids come first.  Repeated rows are written each,
    ordered by text.  An empty table gives a store of no shards.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    root = root or fresh_dir(spark, "tokens")
    docs = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    fs, path = filesystem(root)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary.zdict") as f:
        f.write(train_dictionary(docs, tokenizer))
    sized = docs.select("id", (F.octet_length("text") + 8).alias("w"))
    bounds = range_bounds(sized, "id", "w", shard_bytes)
    sharded = docs.select(shard_of("id", bounds).cast("int").alias("shard"), "id", F.col("text").cast("binary").alias("text"))
    ranged = sharded.repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "text")
    ranged.mapInArrow(_write(root, tokenizer, end_id), _WRITTEN_DDL).write.parquet(f"{root}/written.parquet")
    # one row per shard, of which there are MOST_SHARDS at most, so the running sum and the manifest stay small
    listed = spark.read.parquet(f"{root}/written.parquet").orderBy("shard").collect()
    before, rows = 0, []
    for r in listed:
        rows.append(r.asDict() | {"before": before})
        before += r.n_ids
    sink = io.BytesIO()
    import pyarrow.parquet as pq

    pq.write_table(pa.Table.from_pylist(rows, schema=_WRITTEN.append(pa.field("before", pa.int64()))), sink)
    with fs.open_output_stream(f"{path}/_manifest.parquet.tmp") as f:
        f.write(sink.getvalue())
    fs.move(f"{path}/_manifest.parquet.tmp", f"{path}/manifest.parquet")
    return root


def _open(root: str, cache: dict):
    if "unzip" not in cache:
        fs, path = filesystem(root)
        with fs.open_input_file(f"{path}/dictionary.zdict") as f:
            content = f.read()
        cache.update(fs=fs, path=path, unzip=_decompressor(content), key=hashlib.sha256(content).hexdigest())
    return cache["fs"], cache["path"]


def _index(fs, path: str, name: str, key: str) -> tuple[pa.Table, np.ndarray]:
    with fs.open_input_file(f"{path}/{name}.idx") as f:
        index = ipc.open_file(f).read_all()
    if index.schema.metadata[b"dictionary"].decode() != key:
        raise ValueError(f"{name} was written with another dictionary")
    return index, np.append(index["offset"].to_numpy(), int(index.schema.metadata[b"end"]))


def _reader(root: str, digest: bool):
    cache: dict = {}

    def read(batches):
        trim()
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _open(root, cache)
                index, offsets = _index(fs, path, r["file"], cache["key"])
                if offsets[-1] != r["n_bytes"]:
                    raise ValueError(f"{r['file']} has {offsets[-1]} bytes by its index, the manifest says {r['n_bytes']}")
                counts = index["n_ids"].to_numpy()
                starts = r["before"] + np.cumsum(counts) - counts
                ids = index["doc_id"].to_pylist()
                with fs.open_input_file(f"{path}/{r['file']}.tok") as f:
                    for a in range(0, len(ids), 500):
                        b = min(len(ids), a + 500)
                        data = f.read(int(offsets[b] - offsets[a]))
                        frames = [cache["unzip"].decompress(data[i:j]) for i, j in zip(offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a], strict=True)]
                        out = {"doc_id": pa.array(ids[a:b], pa.int64()), "start": pa.array(starts[a:b], pa.int64())}
                        if digest:
                            out |= {"n_tokens": pa.array([len(x) // 4 for x in frames], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in frames], pa.int64())}
                        else:
                            out["ids"] = pa.array(frames, pa.binary())
                        yield pa.record_batch(out)

    return read


def _read(spark, root: str, digest: bool, ddl: str) -> DataFrame:
    manifest = spark.read.parquet(f"{root}/manifest.parquet")
    n = max(1, manifest.count())
    return manifest.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).mapInArrow(_reader(root, digest), ddl)


def read_tokens(spark, root: str) -> DataFrame:
    """Per document of a store: ``doc_id``, ``start``, ``ids`` (little-endian uint32 bytes), in id order per shard."""
    return _read(spark, root, False, "doc_id long, start long, ids binary")


def read_document(root: str, doc_id: int) -> list[np.ndarray]:
    """The id arrays of one document: the manifest names its shard, an index its place, and one ranged read gets it."""
    import pyarrow.parquet as pq

    cache: dict = {}
    fs, path = _open(root, cache)
    found = []
    for r in pq.read_table(f"{path}/manifest.parquet", filesystem=fs).to_pylist():
        if r["first_id"] is None or not r["first_id"] <= doc_id <= r["last_id"]:
            continue
        index, offsets = _index(fs, path, r["file"], cache["key"])
        for i in np.flatnonzero(index["doc_id"].to_numpy(zero_copy_only=False) == doc_id):
            with fs.open_input_file(f"{path}/{r['file']}.tok") as f:
                f.seek(int(offsets[i]))
                found.append(np.frombuffer(cache["unzip"].decompress(f.read(int(offsets[i + 1] - offsets[i]))), "<u4"))
    return found


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def summary(spark, root: str) -> DataFrame:
    """Per document read back from a store: place, count and checksum of its ids.

    Reading and summing up are one Python stage: two would keep twice the workers.
    """
    return _read(spark, root, True, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    return summary(spark, write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
