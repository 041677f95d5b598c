"""Groups of rows that lie beside each other in a sorted partition, several whole groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_groups(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """The rows of ``batches`` as tables that never cut a group; equal values of ``group`` follow each other."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        column = table[group].combine_chunks()
        cut = pc.index(column, column[-1]).as_py()
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None:
        yield rest


def bounds(column: pa.ChunkedArray) -> np.ndarray:
    """Places where a new value begins, and the length."""
    if not len(column):
        return np.zeros(1, np.int64)
    column = column.combine_chunks()
    new = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(column)]))


def in_cells(rows: DataFrame, size: str, member: str, block: int) -> DataFrame:
    """``rows`` once for each cell they are compared in: a group of ``size`` rows is cut into blocks of about
    ``block`` members, and every pair of blocks (``a`` up to ``b``) is a cell. ``own`` is the block of the row; two rows of one
    block meet in the cell where ``a`` is ``b``, others in one cell of two blocks."""
    blocks = F.greatest(F.ceil(F.col(size) / block), F.lit(1)).cast("int")
    placed = rows.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return placed.withColumns({"a": F.least("own", "_other"), "b": F.greatest("own", "_other")}).drop("_blocks", "_other")
