"""Token ids in length-delimited binary records, with masked checksums and a separate offset index.

A data file is a run of frames; all integers are little-endian::

    u64 length of the payload | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

    payload: u8 flags (1: the document has no id) | u8 bytes of an id, 2 or 4 | i64 doc_id | ids

The mask is ``rotate_right(crc, 15) + 0xa282ead8`` over zlib's CRC-32, so that a checksum of data that
holds checksums stays strong. The index is a Parquet table with a row for each record: file, offset,
length, doc_id, n_tokens. A reader can thus fetch records in any order without reading the files through.

Files hold documents in ascending order of doc_id (no id first; ties by a hash of the text, then by
text). A task writes a file under a name of its own; only files of tasks that ended well are in the
index, so a repeated or lost task leaves at most a file that nobody reads.

Defined results: a null text counts as empty and has just the end id; repeated rows are separate
records; an empty table gives an empty index; extra columns are ignored.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "file string, doc_id long, h long, no long, offset long, length long, n_tokens long"
FOUND = "file string, doc_id long, start long, n_tokens long, ids_crc32 long"
HEAD = struct.Struct("<QI")
ITEM = struct.Struct("<BBq")
CRC = struct.Struct("<I")
CACHED_WORDS = 1_000_000
TEXTS_AT_ONCE = 256


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, CRC.pack(masked(zlib.crc32(size))), payload, CRC.pack(masked(zlib.crc32(payload)))))


def frames(stream) -> Iterator[bytes]:
    """The payloads of an open data file; raises ValueError on a bad length, checksum or end."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("the file ends inside a frame's head")
        size, crc = HEAD.unpack(head)
        if masked(zlib.crc32(head[:8])) != crc:
            raise ValueError("the checksum of a length is wrong")
        body = stream.read(size + 4)
        if len(body) != size + 4:
            raise ValueError("the file ends inside a payload")
        payload = body[:size]
        if masked(zlib.crc32(payload)) != CRC.unpack(body[size:])[0]:
            raise ValueError("the checksum of a payload is wrong")
        yield payload


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return ITEM.pack(doc_id is None, width, doc_id or 0) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, width, doc_id = ITEM.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, f"<u{width}", offset=ITEM.size).astype("<u4")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(columns, kinds)], list(names))


class WordIds:
    """Ids of words, remembered. Texts are cut at ASCII blanks, across which the tokenizer never joins.

    That holds for tokenizers of words that drop white space, as ``word_bpe_49k`` does. It also composes and
    lower-cases, keeps letters apart from marks and digits, and writes bytes as characters (``_BYTES``); so a
    word of letters, in lower case, goes to the merges directly, and a mark after it has ids of its own. All
    other words are encoded by the whole tokenizer, many at a time.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.bytes_of = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks = {m: self._packed(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,;:!?"}

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _merged(self, word: str) -> bytes:
        found = self.letters.get(word)
        if found is None:
            text = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
            known = self.bytes_of
            found = self.letters[word] = b"".join([known[t.id] for t in self.model.tokenize(text)])
        return found

    def _learn(self, words: set[bytes]) -> None:
        rest = []
        for w in words:
            text, after = w.decode(), b""
            if (last := text[-1]) in self.marks and text[-2:-1].isalpha():
                text, after = text[:-1], self.marks[last]
            if text.isalpha() and (text.isascii() or unicodedata.is_normalized("NFC", text) and not _CASED & set(text)):
                self.known[w] = self._merged(text.lower()) + after
            else:
                rest.append(w)
        if rest:
            texts = [w.decode() for w in rest]
            done = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = done.ids
            cuts = np.searchsorted([a for a, _ in done.offsets], np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
            for k, w in enumerate(rest):
                self.known[w] = self._packed(ids[cuts[k] : cuts[k + 1]])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
            self.letters.clear()
        words = [(t or "").encode().split() for t in texts]
        if unknown := set().union(*words).difference(self.known):
            self._learn(unknown)
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, w)) for w in words]


#: A worker's words, by tokenizer; tasks that run in one worker share them.
_WORKERS: dict[str, WordIds] = {}
# Letters whose lower case depends on what stands around them, or is more than one character.
_CASED = frozenset("\u03a3\u0130")
# How the byte-level pre-tokenizer writes bytes: printable ones as they are, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def word_ids(path: str) -> WordIds:
    if path not in _WORKERS:
        _WORKERS[path] = WordIds(path)
    return _WORKERS[path]


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 2) -> DataFrame:
    """Writes ``docs(doc_id, text)`` to ``folder`` (a URI all executors reach) and returns the index, already written."""
    spark = docs.sparkSession
    pafs_of(folder)[0].create_dir(f"{pafs_of(folder)[1]}/data", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs_of(folder)
        name, out, at, no, ids = f"{uuid.uuid4().hex}.rec", None, 0, 0, None
        for b in batches:
            if out is None:
                ids = word_ids(tokenizer_path)
                end = np.array([end_id], f"<u{ids.width}").tobytes()
                out = fs.open_output_stream(f"{base}/data/{name}", buffer_size=1 << 20)
            rows = []
            for first in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(first, TEXTS_AT_ONCE)
                for doc_id, h, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ids.encode(part.column(2).to_pylist())):
                    body += end
                    data = frame(pack(doc_id, body, ids.width))
                    out.write(data)
                    rows.append((name, doc_id, h, no, at, len(data), len(body) // ids.width))
                    at, no = at + len(data), no + 1
            yield _batch(rows, INDEX)
        if out is not None:
            out.close()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    dealt.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def pafs_of(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """FOUND of every record, read from the data files: ``start`` counts the ids of all records before it."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min_by(F.struct("doc_id", "h"), "no").alias("key"))
    # A row a file: the window without a partition sees no records.
    order = Window.orderBy(F.col("key.doc_id").asc_nulls_first(), "key.h").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    # A task a file; a number that is given is kept, where rows dealt by key alone would be joined to one task.
    files = files.repartition(max(1, index.select("file").distinct().count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs_of(folder)
        for b in batches:
            for name, start in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                with fs.open_input_stream(f"{top}/data/{name}", buffer_size=1 << 20) as stream:
                    for payload in frames(stream):
                        doc_id, ids = unpack(payload)
                        rows.append((name, doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield _batch(rows, FOUND)
                            rows = []
                yield _batch(rows, FOUND)

    return files.mapInArrow(run, FOUND)


def fetch(folder: str, file: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index."""
    fs, top = pafs_of(folder)
    with fs.open_input_file(f"{top}/data/{file}") as f:
        f.seek(offset)
        return unpack(next(frames(f)))
