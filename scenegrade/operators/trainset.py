"""Training examples: pairing, exact splits, chat layout, truncation and label masks."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from scenegrade.functions import json_docs as J
from scenegrade.functions import names as N
from scenegrade.sources.files import below_root
from scenegrade.sources.store import shared_path

#: Hexadecimal digits that a step of the split looks at.
DIGITS = 4
IGNORED_LABEL = -100


# ---- pairing -----------------------------------------------------------------
def pair_by_stem(labels: DataFrame, media: DataFrame):
    """(pairs, skipped labels) of one flat folder: ``x.json`` belongs to ``x.mp4``, exactly spelled."""
    named = labels.withColumn("stem", N.strip_json(N.base_name("path"))).withColumnRenamed("path", "label_path")
    clips = (
        media.filter(F.col("path").endswith(".mp4"))
        .withColumn("stem", F.regexp_replace(N.base_name("path"), r"\.mp4$", ""))
        .withColumnRenamed("path", "media_path")
    )
    return named.join(clips, "stem"), named.join(clips.select("stem"), "stem", "left_anti")


def relative_stem(path, root: str) -> Column:
    """Path below ``root`` without its last extension."""
    below = below_root(path, root)
    return F.regexp_replace(below, r"(?<=[^/])\.[^./]+$", "")


def pair_by_tree(media: DataFrame, labels: DataFrame, media_root: str, label_root: str):
    """(pairs, media without a label) of two folder trees that mirror each other."""
    clips = media.withColumn("rel_stem", relative_stem("path", media_root)).withColumnRenamed("path", "media_path")
    texts = (
        labels.filter(F.col("path").endswith(".json"))
        .withColumn("rel_stem", relative_stem("path", label_root))
        .withColumnRenamed("path", "label_path")
    )
    return clips.join(texts, "rel_stem"), clips.join(texts.select("rel_stem"), "rel_stem", "left_anti")


_STRING_OR_SPACE = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+'


# ---- labels and metadata -----------------------------------------------------
def label_texts(pairs: DataFrame, text: str = "text"):
    """(examples with ``label``, rejects): a JSON string is taken as it is, other JSON keeps its text.

    Only white space outside strings goes, so keys stay in order and numbers as they are written.
    """
    parsed = J.parse_documents(pairs, text).withColumn("_is_text", F.col(text).rlike(r'^\s*"'))
    value = F.when(F.col("_is_text"), F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(
        F.regexp_replace(text, _STRING_OR_SPACE, "$1")
    )
    labelled = parsed.withColumn("label", F.when(F.col("json_ok"), value)).select(*pairs.columns, "label")
    return labelled.filter("label is not null"), labelled.filter("label is null").drop("label")


def metadata_examples(lines: DataFrame, video_root: str, line: str = "value"):
    """(examples ``video, label``, rejects ``value, reason``) from JSON lines.

    Blank lines are skipped. ``video`` is a path, or a list holding exactly one; a
    relative path is taken below ``video_root``.
    """
    rows = lines.filter(~J.is_blank(F.col(line)))
    parsed = J.parse_documents(rows, line)
    listed = J.elements("obj", "video")
    video = F.when(listed.isNotNull(), F.when(F.size(listed) == 1, J.text_of(F.get(listed, F.lit(0))))).otherwise(
        J.text_of(J.sub("obj", "video"))
    )
    label = J.text_of(J.sub("obj", "label"))
    reason = (
        F.when(~F.col("parse_ok"), F.lit("bad_json"))
        .when(listed.isNotNull() & (F.size(listed) != 1), F.lit("expected_one_video"))
        .when(F.col("_video").isNull(), F.lit("missing_video"))
        .when(F.col("label").isNull(), F.lit("missing_label"))
    )
    full = F.when(F.col("_video").startswith("/"), F.col("_video")).otherwise(
        F.concat(F.lit(video_root.rstrip("/") + "/"), F.col("_video"))
    )
    read = (
        parsed.withColumn("_video", video).withColumn("label", label)
        .withColumn("reason", reason).withColumn("video", full)
    )
    return (
        read.filter("reason is null").select("video", "label"),
        read.filter("reason is not null").select(line, "reason"),
    )


# ---- exact split -------------------------------------------------------------
def _cut_prefix(rows: DataFrame, cut: int) -> str:
    """Text below which exactly ``cut`` of the distinct ``_order`` texts of ``rows`` sort.

    The texts are counted by their first DIGITS characters; in the one group that the cut falls into they are counted
    by the next ones, and so on, until the cut lies between two groups. A step sees one row per group, and only rows
    that share the prefix so far: nothing is sorted as a whole.
    """
    prefix, before = "", 0
    while True:
        head = F.substring("_order", 1, len(prefix) + DIGITS)
        counts = rows.filter(F.col("_order").startswith(prefix)).groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n"))
        # one row per value of the next digits: at most 65,536, however many rows there are
        sums = counts.withColumn("until", F.sum("n").over(Window.orderBy("head")) + F.lit(before))
        hit = sums.filter(F.col("until") > cut).orderBy("head").limit(1).collect()
        if not hit:
            return "~"  # all rows lie below: no digit is greater
        head, n, until = hit[0]
        if until - n == cut:
            return head
        prefix, before = head, until - n


def exact_split(pairs: DataFrame, ratio: float = 0.8, seed: int = 42, key: str = "stem", store: str | None = None) -> DataFrame:
    """Add ``split``: exactly ``floor(n * ratio)`` rows are ``train``, the rest ``test``.

    Rows are ordered by a seeded hash of ``key``, rows with a NULL key after all others. Rows and their place in that order
    are stored once (at ``store``, or in the session's shared folder), so that rows of equal key, repeated or NULL, are
    told apart by a number of their own and the cut is exact whatever the keys are.
    """
    if not 0.0 < ratio < 1.0:
        raise ValueError("ratio must be between 0 and 1")
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    place = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    order = F.concat(F.when(F.col(key).isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(hashed, F.lit("")), place)
    path = store or shared_path(pairs.sparkSession, "split")
    pairs.withColumn("_order", order).write.parquet(path)
    rows = pairs.sparkSession.read.parquet(path)
    cut = _cut_prefix(rows, math.floor(rows.count() * ratio))
    is_train = F.col("_order") < F.lit(cut)
    return rows.withColumn("split", F.when(is_train, F.lit("train")).otherwise(F.lit("test"))).select(*pairs.columns, "split")


def split_totals(split: DataFrame) -> DataFrame:
    """Row counts per split and in total (``split`` NULL)."""
    return split.rollup("split").agg(F.count(F.lit(1)).alias("n_pairs"))


# ---- examples ----------------------------------------------------------------
def chat_examples(examples: DataFrame, prompt: str, num_frames: int = 10) -> DataFrame:
    """Add ``messages``: user turn with video and prompt, assistant turn with the label."""

    def part(kind, video=None, frames=None, text=None):
        return F.struct(
            F.lit(kind).alias("type"),
            (F.lit(None).cast("string") if video is None else video).alias("video"),
            F.lit(frames).cast("int").alias("num_frames"),
            (F.lit(None).cast("string") if text is None else text).alias("text"),
        )

    user = F.struct(
        F.lit("user").alias("role"),
        F.array(
            part("video", video=F.concat(F.lit("file://"), F.col("video")), frames=num_frames),
            part("text", text=F.lit(prompt)),
        ).alias("content"),
    )
    assistant = F.struct(F.lit("assistant").alias("role"), F.array(part("text", text=F.col("label"))).alias("content"))
    return examples.withColumn("messages", F.array(user, assistant))


def truncate_and_mask(tokens: DataFrame, max_prompt_tokens: int, max_label_tokens: int):
    """(kept, rejected) token rows with ``labels``.

    ``tokens`` has ``input_ids`` and ``prefix_len``. Over-long rows keep the whole prefix
    and the last tokens; a prefix that alone fills the budget rejects its row. Labels
    repeat the ids with the prefix masked.
    """
    budget = max_prompt_tokens + max_label_tokens
    n, prefix = F.size("input_ids"), F.col("prefix_len")
    too_long = n > budget
    keep = F.least(F.lit(budget) - prefix, n)
    # parts of a slice are only taken where they are positive
    tail = F.slice("input_ids", -F.greatest(keep, F.lit(1)), F.greatest(keep, F.lit(1)))
    cut = F.when(too_long, F.concat(F.slice("input_ids", F.lit(1), prefix), tail)).otherwise(F.col("input_ids"))
    masked = F.least(prefix, F.size("input_ids"))
    labels = F.concat(
        F.array_repeat(F.lit(IGNORED_LABEL), masked), F.slice("input_ids", masked + 1, F.size("input_ids"))
    )
    rejected = tokens.filter(too_long & (prefix >= budget)).withColumn(
        "reason", F.lit("prefix_exceeds_budget")
    )
    kept = (
        tokens.filter(~(too_long & (prefix >= budget)))
        .withColumn("input_ids", cut)
        .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
        .withColumn("labels", labels)
    )
    return kept, rejected
