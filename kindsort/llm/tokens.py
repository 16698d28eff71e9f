"""Token ids in binary shards with Elias-Fano document boundaries.

A shard file holds, in this order::

    magic | ids, 2 or 4 bytes each, little endian | boundaries | keys | JSON | its length (8 bytes) | magic

``boundaries`` (the end of each document in the id array) and ``keys`` (document ids
above the shard's smallest) are non-decreasing, and stored by Elias-Fano: the low
bits of each value packed, the high bits as gaps in unary, and the position of every
256th one as a 32-bit number, from which ``select`` finds any value.  That takes
about 2 + log2(range / count) bits a value, where an offset table takes 64.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindsort.session import work_path

MAGIC = b"KSEFIDS1"
SAMPLE = 256
#: Ids read at a time.
BLOCK = 1 << 20
#: Letters below this are letters in every version of Unicode; words of others go to the tokenizer as they are.
PLAIN = "\u0590"
#: What byte-level BPE writes for a byte: printable ones stand for themselves, the others for letters from 256 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
AS_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}


class EliasFano:
    """A non-decreasing sequence of integers of 0 or more."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        values = values.astype(np.uint64)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(high[-1]) + 1, np.uint8)
        ones[high] = 1
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((n, 0), np.uint8)
        pack = lambda a: np.packbits(a.reshape(-1), bitorder="little").tobytes()
        return cls(n, low_bits, pack(bits), pack(ones), high[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at, value = i * self.low_bits, 0
        for k, byte in enumerate(self.low[at // 8 : (at + self.low_bits + 7) // 8]):
            value |= int(byte) << (8 * k)
        return (value >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value ``i``: the ``i``-th one of the high bits, found from the sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        word[: at % 8] = 0
        while left >= (ones := int(word.sum())):
            left -= ones
            byte += 1
            word = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        position = byte * 8 + int(np.flatnonzero(word)[left])
        return ((position - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """All values as unsigned 64-bit integers."""
        if not self.n:
            return np.zeros(0, np.uint64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.zeros(self.n, np.uint64)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                low |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | low

    def parts(self) -> tuple[dict, bytes]:
        low, high, samples = self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()
        return {"n": self.n, "low_bits": self.low_bits, "low": len(low), "high": len(high), "samples": len(samples)}, low + high + samples

    @classmethod
    def read(cls, head: dict, data: bytes) -> EliasFano:
        a, b = head["low"], head["low"] + head["high"]
        return cls(head["n"], head["low_bits"], data[:a], data[a:b], data[b : b + head["samples"]])


class _Whole(Exception):
    """The text must go to the tokenizer whole."""


class _Memo(dict):
    """Ids of each piece met, worked out once."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.learn(piece)
        return ids


class Encoder:
    """Ids of whole texts by a tokenizer file, remembering what each word became.

    In byte-level BPE a single space between other characters starts a new piece
    whatever stands before it, so such a text falls apart at its spaces into pieces
    that can be encoded alone; pieces met before are looked up, and a new piece that is
    a plain word goes straight to the tokenizer's merges.  A text with other white
    space beside a space, or that spells one of the added tokens, goes to the tokenizer
    whole.  All ways give the tokenizer's own ids (tested).
    """

    def __init__(self, path: str, memo: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = [a for a in self.added if " " in a]
        self.bytes = [i.to_bytes(self.width, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.merge = self.tokenizer.model.tokenize
        self.marks = dict(zip(".,!?;:", self._ids(list(".,!?;:")), strict=True))
        (self.line,) = self._ids(["\n"])
        self.most, self.memo = memo, _Memo(self._piece)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, space: str) -> bytes:
        """Ids of a run without white space, after a space or not (``space`` empty)."""
        if word.isalpha() and (word.isascii() or max(word) < PLAIN):
            said = word if word.isascii() else word.encode().decode("latin1").translate(AS_LETTERS)
            return b"".join([self.bytes[t.id] for t in self.merge("Ġ" + said if space else said)])
        if word[-1] in self.marks and word[:-1].isalpha():  # the tokenizer's pattern parts words from marks
            return (self.memo[word[:-1]] if space else self._word(word[:-1], space)) + self.marks[word[-1]]
        return self._ids([space + word])[0]

    def _piece(self, piece: str, space: str = " ") -> bytes:
        """Ids of what stands between two single spaces, with the first of them (none at the start of a text)."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Whole
        for a in self.added:
            if a in piece:
                raise _Whole
        i = piece.find("\n")
        if i > 0 and not piece[i - 1].isspace() and not piece[i + 1].isspace():  # a line break alone parts two words
            return self._word(piece[:i], space) + self.line + self._word(piece[i + 1 :], "")
        return self._word(piece, space)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes."""
        if len(self.memo) > self.most:
            self.memo = _Memo(self._piece)
        first, *rest = text.split(" ")
        try:
            if self.spaced and any(a in text for a in self.spaced):
                raise _Whole
            return self._piece(first, "") + b"".join(map(self.memo.__getitem__, rest))
        except _Whole:
            return self._ids([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Shared store and path in it; ``file:/x`` is what Hadoop calls ``file:///x``."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


MANIFEST = "shard int, file string, docs long, tokens long, nulls long, smallest long"


def write_ids(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Encodes every text (null: empty), appends ``end_id`` and writes shard files in key order.

    Rows are dealt by key range, one shard a partition; a task streams its ids to a file
    of its own and holds a key and a length a document.  The manifest, one row a shard,
    is a table in ``folder`` and names the file of the attempt that was committed, so a
    lost or doubled task leaves at most a file that nobody names.  Null keys come
    first; rows that share a key follow each other by text, and where they are more than
    a shard holds, texts that begin alike may follow in another order.
    """
    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = shards or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, most = rows.groupBy("key").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    # a key with more rows than a shard has on average is cut by its texts, and equal beginnings by their place
    by = ["key", F.substring("text", 1, 32), F.monotonically_increasing_id()] if most * parts > n and most > 1 else ["key"]
    dealt = rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        keys, ends, nulls, total, out, file = [], [], 0, 0, None, ""
        store, base = store_of(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                file = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{file}")
                out.write(MAGIC)
            column = batch.column("key")
            nulls += column.null_count
            keys.append(column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            texts = batch.column("text")
            for t in texts:
                ids = enc.encode(t.as_py())
                out.write(ids + end)
                total += len(ids) // enc.width + 1
                ends.append(total)
        if out is None:
            return
        named = np.concatenate(keys)
        smallest = int(named[0]) if len(named) else 0
        body = b""
        head = {"width": enc.width, "docs": len(ends), "tokens": total, "nulls": nulls, "smallest": smallest}
        above = named.view(np.uint64) - np.array([smallest], np.int64).view(np.uint64)  # exact for any two longs
        for name, values in (("boundaries", np.array(ends, np.uint64)), ("keys", above)):
            head[name], data = EliasFano.of(values).parts()
            body += data
        meta = json.dumps(head).encode()
        out.write(body + meta + struct.pack("<q", len(meta)) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [file], "docs": [len(ends)], "tokens": [total], "nulls": [nulls], "smallest": [smallest]})

    made = dealt.sortWithinPartitions("key", "text").mapInArrow(write, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return documents.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class Shard:
    """A shard file: documents by place, without reading the rest."""

    def __init__(self, folder: str, file: str):
        store, base = store_of(folder)
        self.file = store.open_input_file(f"{base}/{file}")
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        assert tail[8:] == MAGIC, f"{file} is not a whole id file"
        (n,) = struct.unpack("<q", tail[:8])
        self.head = json.loads(self.file.read_at(n, size - 8 - len(MAGIC) - n))
        self.width = self.head["width"]
        at, parts = len(MAGIC) + self.width * self.head["tokens"], []
        for name in ("boundaries", "keys"):
            h = self.head[name]
            length = h["low"] + h["high"] + h["samples"]
            parts.append(EliasFano.read(h, self.file.read_at(length, at)))
            at += length
        self.boundaries, self.keys = parts

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i`` of the shard, its end id included."""
        return self.ids(self.boundaries.select(i - 1) if i else 0, self.boundaries.select(i))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start, ids) in order, reading about ``BLOCK`` ids at a time."""
        ends = self.boundaries.all().astype(np.int64)
        keys = (self.keys.all() + np.array([self.head["smallest"]], np.int64).view(np.uint64)).view(np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        i, nulls = 0, self.head["nulls"]
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
            block = self.ids(int(starts[i]), int(ends[j - 1]))
            for k in range(i, j):
                yield (None if k < nulls else int(keys[k - nulls])), int(starts[k]), block[starts[k] - starts[i] : ends[k] - starts[i]]
            i = j


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """One row a document from the files: ``key, start, n_tokens, ids_crc32``.

    ``start``: ids of all documents before it, over all shards.  ``ids_crc32``: of its
    ids as little-endian 32-bit integers.
    """
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = shards.select("file", before.alias("before")).repartition(max(1, shards.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            k, s, n, c = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

        for b in batches:
            for file, at in zip(b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
                rows = []
                for k, start, ids in Shard(folder, file).documents():
                    rows.append((k, at + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return dealt.mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def encode_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``documents`` to a new folder of the shared work folder and reads them back."""
    spark = documents.sparkSession
    folder = work_path(spark, "token-ids")
    write_ids(documents, folder, tokenizer, end_id, key, text)
    return read_ids(spark, folder, key)
