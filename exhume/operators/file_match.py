"""Matching recovered files to ground-truth files (J5-J7) and the row flags built on it.

Ground truth is reduced to three look-up tables with one row per key (name, block set, first block),
so every join below is an equi-join against unique keys and cannot multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exhume.functions import blocks as B
from exhume.functions.names import is_fat, name_keys, visible_name
from exhume.functions.text import case_key, null_token, to_int
from exhume.operators.ordered import first_rows
from exhume.session import stage

TIMES = ["modified_timestamp", "accessed_timestamp", "changed_timestamp"]


def prepare_ground_truth(gt: DataFrame) -> DataFrame:
    """Canonical columns of ground-truth files, written once because every index reads them."""
    fat, plain = name_keys(F.col("_visible"))
    whole = {n for n, kind in gt.dtypes if kind in ("bigint", "int", "smallint", "tinyint")}
    number = lambda c: F.col(c).cast("bigint") if c in whole else to_int(null_token(F.col(c).cast("string")))
    keyed = gt.withColumn("_visible", visible_name(F.col("file_name"))).select(
        case_key(F.col("base_test_case")).alias("_case"),
        "file_name", "gt_pos", number("size").alias("size"), *[number(t).alias(t) for t in TIMES],
        fat.alias("fat_key"), plain.alias("plain_key"), F.col("dfr_blocks").alias("blocks"),
    )
    return stage(with_blocks(keyed))


def prepare_submission(sub: DataFrame, run: list[str]) -> DataFrame:
    """Canonical columns of submitted files; test sets are compared in upper case."""
    fat, plain = name_keys(F.col("_visible"))
    number = lambda c: to_int(F.col(c).cast("string"))
    return sub.withColumn("_visible", visible_name(F.col("file_name"))).select(
        *run,
        case_key(F.col("base_test_case")).alias("_case"),
        F.upper(F.trim("test_set")).alias("test_set"),
        "file_name", "sub_pos", number("file_size").alias("file_size"),
        *[number(t).alias(t) for t in TIMES],
        is_fat(F.col("file_system")).alias("is_fat"),
        F.when(is_fat(F.col("file_system")), fat).otherwise(plain).alias("name_key"),
        "blocks",
    )


def with_blocks(df: DataFrame) -> DataFrame:
    """Add set_size, block_key, first_block and has_tokens of the block text."""
    return B.compute_once(df, B.block_summary(F.col("blocks"))).drop("blocks")


def name_index(gt: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """First ground-truth row per (case, name key), for FAT and other systems alike; of those only that ``kinds`` (_case, is_fat) has, if given."""
    if kinds is None:
        keyed = gt.withColumn("name_key", F.explode(F.array_distinct(F.array("fat_key", "plain_key"))))
    else:
        keyed = gt.join(kinds, "_case").withColumn("name_key", F.when(F.col("is_fat"), F.col("fat_key")).otherwise(F.col("plain_key")))
    keyed = keyed.filter(F.col("name_key").isNotNull())
    return first_rows(keyed, ["_case", "name_key"], [F.col("gt_pos")], ["file_name", "size", "set_size"]).select(
        "_case", "name_key",
        F.col("file_name").alias("n_file"), F.col("size").alias("n_size"), F.col("set_size").alias("n_set"),
    )


def block_set_index(gt: DataFrame) -> DataFrame:
    """First ground-truth row per (case, block set)."""
    keyed = gt.filter(F.col("block_key").isNotNull())
    return first_rows(keyed, ["_case", "block_key"], [F.col("gt_pos")], ["file_name", "size", "set_size"]).select(
        "_case", "block_key",
        F.col("file_name").alias("b_file"), F.col("size").alias("b_size"), F.col("set_size").alias("b_set"),
    )


def first_block_index(gt: DataFrame) -> DataFrame:
    """Per (case, first block) the number of rows, the size if there is one row, and the three
    smallest block sets under distinct names.

    Three are enough: the question asked of them is the smallest set under a name other than (at
    most) two given ones. No list of all rows sharing a first block is ever built.
    """
    key = ["_case", "first_block"]
    named = (
        gt.filter(F.col("first_block").isNotNull())
        .groupBy(*key, "file_name")
        .agg(
            F.min_by("set_size", "gt_pos").alias("_set"),
        )
    )
    # counted before rows of a name are put together, so that those are dealt once
    totals = gt.filter(F.col("first_block").isNotNull()).groupBy(*key).agg(F.count("*").alias("f_rows"), F.max("size").alias("_size"))
    order = Window.partitionBy(*key).orderBy("_set", "file_name")
    smallest = (
        named.withColumn("_rn", F.row_number().over(order))
        .filter("_rn <= 3")
        .groupBy(*key)
        .agg(F.collect_list(F.struct(F.col("_set").alias("n"), F.col("file_name").alias("name"))).alias("f_sets"))
    )
    return totals.join(smallest, key).select(
        *key, "f_rows", F.when(F.col("f_rows") == 1, F.col("_size")).alias("f_size"), "f_sets"
    )


def size_index(gt: DataFrame) -> DataFrame:
    return gt.filter(F.col("size").isNotNull()).select(
        "_case", F.col("size").alias("file_size"), F.lit(True).alias("s_hit")
    ).distinct()


def match_files(sub: DataFrame, gt: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Submitted files with the ground-truth rows found by name, block set, first block and size.

    ``kinds`` (_case, is_fat) are those of ``sub``, where a caller has them.
    """
    return (
        with_blocks(sub)
        .join(name_index(gt, kinds), ["_case", "name_key"], "left")
        .join(block_set_index(gt), ["_case", "block_key"], "left")
        .join(first_block_index(gt), ["_case", "first_block"], "left")
        .join(size_index(gt), ["_case", "file_size"], "left")
    )


def with_flags(matched: DataFrame) -> DataFrame:
    """R1-R4 as boolean columns: ss, full, first, match, over, multi, size_match."""
    size = F.col("file_size")
    match = F.col("n_file").isNotNull()
    full = F.col("b_file").isNotNull()
    first = F.col("f_rows").isNotNull()

    def smaller(n: Column) -> Column:
        return F.coalesce((n > 0) & (n < F.col("set_size")), F.lit(False))

    same_name = F.coalesce(F.col("b_file") == F.col("n_file"), F.lit(False))
    others = F.filter(
        "f_sets",
        lambda c: ~F.coalesce(c["name"] == F.col("n_file"), F.lit(False))
        & ~F.coalesce(c["name"] == F.col("b_file"), F.lit(False)),
    )
    over = (
        smaller(F.col("n_set"))
        | (~same_name & smaller(F.col("b_set")))
        | smaller(F.array_min(F.transform(others, lambda c: c["n"])))
    )
    by_name = F.coalesce(F.col("n_size") == size, F.lit(False))
    by_set = F.coalesce(F.col("b_size") == size, F.lit(False))
    by_first = F.coalesce(F.col("f_size") == size, F.lit(False))
    size_match = F.when(
        F.col("test_set") == "FILE_SIZE_TESTS", F.coalesce(F.col("s_hit"), F.lit(False))
    ).otherwise(by_name | F.when(full, by_set).otherwise(first & by_first))
    return (
        matched.withColumn("ss", F.col("set_size") > 0)
        .withColumn("full", full)
        .withColumn("first", first)
        .withColumn("match", match)
        .withColumn("over", over)
        .withColumn("multi", first & ~full)
        .withColumn("size_match", size_match)
    )
