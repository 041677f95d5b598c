"""Token files: ids compressed document by document with one shared dictionary, behind an offset index.

A file holds: magic, SHA-256 of the dictionary, bytes per id; one zstandard frame per document; the index
(offset, bytes and ids of each frame, 8 bytes each) and the number of documents. The dictionary lies beside the files under its
hash, and a reader refuses another one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exhume.llm.shared_files import Reader, new_file, opened, runs
from exhume.llm.text_stats import hash_below
from exhume.llm.tokens import encoder
from exhume.session import Scratch

MAGIC = b"TOKZ1\n"
HEAD = len(MAGIC) + 32 + 1
#: Bytes of frames in one file, about.
FILE_BYTES = 64 << 20
#: The dictionary is trained on so many documents of least hash, on at most so many characters of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4000, 64 << 10


def serialised(ids: bytes, width: int) -> bytes:
    """Little-endian 32-bit ids in ``width`` bytes each."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def restored(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, text: str, vocabulary: str, end: int) -> tuple[bytes, int]:
    """Dictionary (empty where there is too little to learn from) and bytes per id.

    Only the stated sample reaches the driver; a longer text is sampled from a place that its hash names.
    """
    coder = encoder(vocabulary)
    width = 2 if max(coder.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    place = F.pmod(F.xxhash64(whole), F.greatest(F.length(whole) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    sampled = docs.select(F.xxhash64(whole).alias("h"), F.substring(whole, place, F.lit(SAMPLE_CHARS)).alias("t"))
    low = sampled.filter(F.col("h") <= hash_below(SAMPLE_DOCUMENTS, docs.count())).groupBy("h").agg(F.min("t").alias("t"))
    samples = [serialised(coder.encode(r.t), width) for r in low.orderBy("h").limit(SAMPLE_DOCUMENTS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), width
    except (zstandard.ZstdError, ValueError):
        return b"", width


def _settings(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def compress_documents(docs: DataFrame, text: str, key: str, vocabulary: str, end: int, dictionary: bytes, width: int) -> DataFrame:
    """(key, n_tokens, frame) of every row; ``end`` follows the ids of each document, a null text has only that."""
    tail = struct.pack("<I", end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, compressor = encoder(vocabulary), zstandard.ZstdCompressor(level=3, **_settings(dictionary))
        for batch in batches:
            lengths, frames = [], []
            for t in batch.column(1):
                ids = coder.encode(t.as_py()) + tail
                lengths.append(len(ids) // 4)
                frames.append(compressor.compress(serialised(ids, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(frames, pa.binary())], ["key", "n_tokens", "frame"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"key {kind}, n_tokens bigint, frame binary")


def write_files(frames: DataFrame, folder: str, dictionary: bytes, width: int) -> DataFrame:
    """One file per partition of ``frames``, in the order of its rows; returns the index, a row per document.

    ``start`` counts the ids of the file's earlier documents.
    """
    kind = frames.schema["key"].dataType.simpleString()
    digest = hashlib.sha256(dictionary).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = stream = None
        offset, start, index = HEAD, 0, []
        for batch in batches:
            if stream is None:
                uri, stream = new_file(folder, ".tokens")
                stream.write(MAGIC + digest + bytes([width]))
            offsets, starts = [], []
            for frame, count in zip(batch.column("frame"), batch.column("n_tokens").to_pylist()):
                data = frame.as_py()
                stream.write(data)
                offsets.append(offset)
                starts.append(start)
                index.append((offset, len(data), count))
                offset, start = offset + len(data), start + count
            sizes = [x[1] for x in index[-len(offsets):]] if offsets else []
            made = {"file": pa.array([uri] * len(offsets), pa.string()), "offset": pa.array(offsets, pa.int64()), "size": pa.array(sizes, pa.int64()), "start": pa.array(starts, pa.int64())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("key", "tie", "n_tokens")} | made)
        if stream is not None:
            stream.write(np.array(index, "<i8").tobytes() + struct.pack("<q", len(index)))
            stream.close()

    return frames.mapInArrow(write, f"key {kind}, tie bigint, n_tokens bigint, file string, offset bigint, size bigint, start bigint")


def read_index(uri: str) -> tuple[bytes, int, np.ndarray]:
    """Dictionary hash, bytes per id and the (offset, bytes, ids) rows of one file, from the file alone."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        head = file.read_at(HEAD, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"no token file: {uri}")
        end = file.size() - 8
        count = struct.unpack("<q", file.read_at(8, end))[0]
        index = np.frombuffer(file.read_at(24 * count, end - 24 * count), "<i8").reshape(count, 3)
        return head[len(MAGIC) : -1], head[-1], index


@lru_cache(maxsize=8)
def _dictionary(folder: str, digest: bytes) -> bytes:
    system, path = opened(f"{folder}/{digest.hex()}.dictionary")
    with system.open_input_file(path) as file:
        data = file.read()
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("the dictionary does not have the hash that the file names")
    return data


def read_documents(index: DataFrame, checksums: bool = False) -> DataFrame:
    """(key, file, start, n_tokens, ids) of indexed documents, by coalesced reads of the rows' byte ranges.

    Rows of a file should come in the order of their offsets (as the index has them); any order is right. With ``checksums``
    the rows have ``ids_crc32``, the unsigned CRC-32 of the ids as 32-bit little-endian numbers, instead of the ids themselves.
    """
    last, last_kind, packed = ("ids_crc32", "bigint", pa.int64()) if checksums else ("ids", "binary", pa.binary())
    kind = index.schema["key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, head, unpack, width = Reader(), None, None, 0
        for batch in batches:
            files, ids = batch.column("file").to_pylist(), []
            spans = list(zip(batch.column("offset").to_pylist(), batch.column("size").to_pylist()))
            for a, b in runs(files):
                if files[a] != head:
                    head = files[a]
                    digest, width, _ = _head(head)
                    unpack = zstandard.ZstdDecompressor(**_settings(_dictionary(head.rpartition("/")[0], digest)))
                order = sorted(range(a, b), key=lambda i: spans[i])
                data = dict(zip(order, reader.read(head, [spans[i] for i in order])))
                found = (restored(unpack.decompress(data[i]), width) for i in range(a, b))
                ids += map(zlib.crc32, found) if checksums else found
            columns = [batch.column(c) for c in ("key", "file", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, packed)], ["key", "file", "start", "n_tokens", last])
        reader.close()

    return index.select("key", "file", "start", "n_tokens", "offset", "size").mapInArrow(
        read, f"key {kind}, file string, start bigint, n_tokens bigint, {last} {last_kind}"
    )


def _head(uri: str) -> tuple[bytes, int, None]:
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        head = file.read_at(HEAD, 0)
    return head[len(MAGIC) : -1], head[-1], None


def write_corpus(docs: DataFrame, folder: str, vocabulary: str, end: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token files of all rows in ascending order of ``key`` below ``folder``; returns the staged index.

    ``start`` is the number of ids of all documents before, in all files. Rows with equal keys follow each other in
    the order of their frames' hashes; null keys come first. A null or empty text is a document of the end id alone;
    an empty table has no file. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession)
    dictionary, width = train_dictionary(docs, text, vocabulary, end)
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as out:
        out.write(dictionary)
    # staged, as dealing rows out by ranges reads them twice
    frames = scratch.write(compress_documents(docs, text, key, vocabulary, end, dictionary, width).withColumn("tie", F.xxhash64("frame")))
    # the number of files follows from the bytes, as a file is written and read back by one task each
    total = frames.agg(F.sum(F.octet_length("frame") + 64)).first()[0] or 0
    ordered = frames.repartitionByRange(max(1, -(-total // FILE_BYTES)), "key", "tie").sortWithinPartitions("key", "tie", "n_tokens")
    index = scratch.write(write_files(ordered, folder, dictionary, width))
    scratch.drop(frames)
    return index


def global_starts(index: DataFrame) -> DataFrame:
    """(file, base): ids in all files before; one row per file."""
    place = F.struct(F.col("key").isNotNull().alias("named"), "key", "tie")
    files = index.groupBy("file").agg(F.min(place).alias("first"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
