"""Bytes in chunks: the data source, files above 2 GiB, and operators on chunk rows beside plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from exhume.operators import byte_blocks, byte_compare, chunks
from exhume.operators.raw_search import keyword_search_files
from exhume.sources.chunks import ChunkReader, read_chunks
from exhume.sources.inputs import file_manifest


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    draw, top = random.Random(2), tmp_path_factory.mktemp("bytes")
    data = {"a.bin": b"", "b.bin": draw.randbytes(1), "c.bin": draw.randbytes(1000), "sub/d.bin": draw.randbytes(100) + bytes(900) + draw.randbytes(117)}
    for name, content in data.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_bytes(content)
    return str(top), data


@pytest.mark.parametrize("uri", [False, True])
def test_source_gives_all_bytes_with_their_neighbours(spark, tree, uri):
    top, data = tree
    rows = read_chunks(spark, f"file://{top}" if uri else top, size=64, before=5, behind=7).collect()
    for name, content in data.items():
        mine = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r["at"])
        assert b"".join(r.bytes[r.lead : r.lead + r.own] for r in mine) == content and {r.length for r in mine} == {len(content)}
        for r in mine:
            assert r.bytes == content[max(0, r["at"] - 5) : r["at"] + r.own + 7] and r.lead == min(5, r["at"])
    assert read_chunks(spark, f"{top}/c.bin", size=100).count() == 10
    with pytest.raises(ValueError):
        ChunkReader({"path": top, "size": "0"})


def test_partitions_cut_large_files_and_gather_small_ones(tree):
    top, data = tree
    parts = ChunkReader({"path": top, "size": "64", "partitionBytes": "256"}).partitions()
    spans = [x for p in parts for x in p.ranges]
    assert all(end - start <= 256 and start % 64 == 0 for _, _, start, end in spans) and len(parts) > 8
    assert sum(end - start for _, _, start, end in spans) == sum(map(len, data.values()))
    assert len(ChunkReader({"path": top}).partitions()) == 1


def sparse(path, size, at, mark):
    with open(path, "wb") as f:
        f.truncate(size)
        f.seek(at)
        f.write(mark)


def test_a_sparse_file_above_two_gigabytes(spark, tmp_path):
    size, at = (2 << 30) + 5_000_000, (2 << 30) + 123_457
    sparse(tmp_path / "a.img", size, at, b"needle")
    rows = read_chunks(spark, str(tmp_path), behind=512).withColumn("pair", F.lit("p"))
    blocks = byte_blocks.byte_blocks(rows, ["pair"]).collect()
    assert [(r["index"], r.offset, r.size) for r in blocks] == [(at // 512, at // 512 * 512, 512)]
    found = file_manifest(spark, str(tmp_path)).collect()
    assert [(r.name, r.size_bytes, len(r.sha256)) for r in found] == [("a.img", size, 64)]


def test_search_and_comparison_over_many_chunks(spark, tmp_path):
    size, at = (20 << 20) + 5000, (18 << 20) - 4
    sparse(tmp_path / "a.img", size, at, b"needle-one")
    sparse(tmp_path / "b.img", size, at, b"needle-two")
    hits = keyword_search_files(spark, str(tmp_path), ["needle"]).collect()
    assert [(r.path[-5:], r.offset) for r in sorted(hits)] == [("a.img", at), ("b.img", at)]
    rows = read_chunks(spark, str(tmp_path)).withColumn("file", F.substring("path", -5, 5))
    side = lambda n: rows.filter(F.col("file") == n).select(F.lit("p").alias("pair"), F.lit(0).cast("bigint").alias("offset"), *chunks.COLUMNS)
    got = byte_compare.byte_compare(side("a.img"), side("b.img"), ["pair", "offset"]).collect()[0]
    assert (got.o_bytes, got.total_bytes, got.diff_bytes, got.first_diff, got.longest_equal_run) == (size, size, 3, at + 7, at + 7)
    lock = byte_compare.lockstep_compare(side("a.img"), side("b.img"), ["pair"], align=700).collect()[0]
    assert (lock.size_a, lock.diff_bytes, lock.first_diff, lock.matching_blocks, lock.total_blocks) == (size, 3, at + 7 - 700, -(-(size - 700) // 512) - 1, -(-(size - 700) // 512))


def test_manifest_hashes_as_plain_python(spark, tree):
    top, data = tree
    got = {r.name: (r.size_bytes, r.sha256) for r in file_manifest(spark, top).collect()}
    assert got == {n.split("/")[-1]: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items() if c}


@pytest.mark.parametrize(("block", "stride"), [(16, 16), (16, 5), (7, 16), (64, 3)])
def test_blocks_over_chunk_borders(spark, block, stride):
    draw = random.Random(block)
    files = [(i, draw.choice([bytes(draw.randrange(90)), draw.randbytes(draw.randrange(200))]) + bytes(40)) for i in range(12)] + [(99, b""), (100, None)]
    frame = spark.createDataFrame(files, "id int, content binary")
    whole = byte_blocks.byte_blocks(frame, ["id"], block_size=block, stride=stride)
    cut = byte_blocks.byte_blocks(chunks.cut(frame, ["id"], size=23, behind=block), ["id"], block_size=block, stride=stride)
    want = sorted(
        (i, n, at, len(b), hashlib.sha256(b).digest())
        for i, c in files for n, at in enumerate(range(0, len(c or b""), stride)) if (b := c[at : at + block]).strip(b"\0")
    )
    flat = lambda df: sorted((r["id"], r["index"], r["offset"], r["size"], bytes(r["hash"])) for r in df.collect())
    assert flat(whole) == want == flat(cut)


@pytest.mark.parametrize("start", [0, 1, 10, 33, 64, 500])
def test_regrid_keeps_bytes(spark, start):
    draw = random.Random(start)
    files = [(i, draw.randbytes(draw.randrange(130))) for i in range(10)]
    frame = spark.createDataFrame(files, "id int, content binary")
    for size in (8, 32, 100):
        got = chunks.regrid(chunks.cut(frame, ["id"], size=32), ["id"], F.lit(start), "b", size).collect()
        assert {(r.id, r.chunk_no): bytes(r.b) for r in got} == {
            (i, n): c[start:][at : at + size] for i, c in files for n, at in enumerate(range(0, len(c[start:]), size))
        }
