"""Exact deduplication by sorting contents (built-in DataFrame functions only)."""

from pyspark.sql import DataFrame, Window, functions as F

from scenegrade.llm.common import open_row, tasks_for, with_row

#: Characters of a text that splitters hold.
PREFIX = 32


def exact_duplicates(df: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text"):
    """Groups of rows with identical text; one row stays of each.

    Sampled splitters range-partition the texts by their first PREFIX characters and a 64-bit hash (so samples stay
    small however long texts are), an external sort by these and the whole text places equal texts side by side, and
    each run of equal neighbours, compared in full, is numbered. A text whose copies exceed a fair share of one task
    would land in one range whole; such texts (at most four per task, found by exact counts of 64-bit hashes) are
    aggregated on the map side instead, grouped by the full text.

    Returns doc_id, text_sha256, keep_id, group_size, kept, then text, was_null and the other columns as `row`. Null text counts as empty.
    `keep` is 'smallest' or 'largest' id; null ids lose against others. Rows that agree in text and id are copies of
    each other: exactly one row of each group has kept = true. An empty input gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    rows = with_row(df, without=text_column, doc_id=id_column, text=text_column)
    rows = rows.withColumn("was_null", F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts = tasks_for(df)
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # Fewer than 4 * parts hashes can hold more than total / (4 * parts) rows each.
    hot = counts.filter(F.col("n") > F.lit(max(8, rows.count() // (4 * parts)))).select("h")

    run = Window.partitionBy("prefix", "h", "text").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    result = ["doc_id", "text_sha256", "keep_id", "group_size", "kept", "text", "was_null", "row"]
    sorted_texts = (
        rows.join(F.broadcast(hot), "h", "left_anti")
        .withColumn("prefix", F.substring("text", 1, PREFIX))
        .repartitionByRange(parts, "prefix", "h")
        .withColumn("place", F.row_number().over(run))
        .withColumn("keep_id", F.first("doc_id").over(run))
        .withColumn("group_size", F.count(F.lit(1)).over(whole))
        .withColumn("text_sha256", F.sha2("text", 256))
        .withColumn("kept", F.col("place") == 1)
        .select(*result)
    )

    copies = rows.join(F.broadcast(hot), "h", "left_semi").withColumn("text_sha256", F.sha2("text", 256))
    groups = (
        copies.groupBy("text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # One row for each hot text, so the same bound holds for this broadcast.
    judged = copies.join(F.broadcast(groups), "text_sha256")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    again = Window.partitionBy("text_sha256").orderBy("doc_id")
    stays = judged.filter(first).withColumn("kept", F.row_number().over(again) == 1)
    goes = judged.filter(~first).withColumn("kept", F.lit(False))
    return sorted_texts.unionByName(stays.select(*result)).unionByName(goes.select(*result))


def drop_exact_duplicates(df: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text"):
    """The rows of `df` that stay, with all its columns."""
    stays = exact_duplicates(df, keep, id_column, text_column).filter("kept")
    return open_row(stays, df, **{text_column: F.when(~F.col("was_null"), F.col("text"))})
