"""Files as chunk rows: (keys, length, at, own, bytes), where ``own`` bytes from ``at`` on belong to the row and further ones to its neighbour.

``sources.chunks`` reads files in this shape; ``cut`` brings binary cells into it. No operator on bytes needs a file in one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exhume.functions.blocks import let

CHUNK = 1 << 20
COLUMNS = ["length", "at", "own", "bytes"]


def cut(files: DataFrame, keys: list[str], content: str = "content", size: int = CHUNK, behind: int = 0) -> DataFrame:
    """Chunk rows of binary cells; a null cell has none, an empty one a row without bytes."""
    length = F.octet_length(content)
    starts = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size))
    # bound once, as every look at the column would copy the whole cell
    rows = let(F.col(content), lambda data: F.transform(starts, lambda at: F.struct(
        length.cast("bigint").alias("length"), at.cast("bigint").alias("at"), F.least(F.lit(size), length - at).alias("own"),
        F.substring(data, at + 1, F.lit(size + behind)).alias("bytes"),
    )))
    return files.filter(F.col(content).isNotNull()).select(*keys, F.inline(rows))


def chunked(files: DataFrame, keys: list[str], content: str = "content", size: int = CHUNK, behind: int = 0) -> DataFrame:
    """``files`` as chunk rows, whichever of the two shapes they have."""
    return files.select(*keys, *COLUMNS) if "at" in files.columns else cut(files, keys, content, size, behind)


def lengths(chunks: DataFrame, keys: list[str], out: str) -> DataFrame:
    """(keys, out): bytes of every file."""
    return chunks.filter(F.col("at") == 0).select(*keys, F.col("length").alias(out))


def regrid(chunks: DataFrame, keys: list[str], start: Column, out: str, size: int = CHUNK) -> DataFrame:
    """(keys, chunk_no, out): the bytes from ``start`` on in pieces of ``size``, whatever the chunks were.

    A piece is put together from the chunks that reach into it, dealt by the key that pieces of two files are joined by.
    """
    own = F.substring("bytes", F.lit(1), F.col("own"))
    moved = chunks.filter((F.col("own") > 0) & (F.col("at") + F.col("own") > start))
    moved = moved.select(*keys, (F.col("at") - start).alias("_rel"), F.col("own").cast("bigint").alias("_n"), own.alias("_b"))
    first = F.floor(F.greatest(F.col("_rel"), F.lit(0)) / size)
    numbers = F.sequence(first, F.floor((F.col("_rel") + F.col("_n") - 1) / size))

    def piece(number: Column) -> Column:
        low = F.greatest(number * size, F.col("_rel"))
        high = F.least((number + 1) * size, F.col("_rel") + F.col("_n"))
        data = F.substring("_b", (low - F.col("_rel") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(number.alias("chunk_no"), low.alias("from"), data.alias("data"))

    pieces = moved.select(*keys, F.inline(F.transform(numbers, piece)))
    parts = F.array_sort(F.collect_list(F.struct("from", "data")))
    joined = pieces.groupBy(*keys, "chunk_no").agg(parts.alias("_p"))
    whole = F.when(F.size("_p") == 1, F.get("_p", F.lit(0))["data"]).otherwise(
        F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    )
    return joined.select(*keys, "chunk_no", whole.alias(out))
