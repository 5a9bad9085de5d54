"""File-name rules: ids, models, runs and output names."""

from pyspark.sql import Column, functions as F

from scenegrade.functions.json_docs import col

TEACHER_RUN = r"^(.+)\.teacher\.(?:perception_raw\.)?run_.*\.json$"
RAW_RUN = r"^(.+)\.teacher\.perception_raw\.run_([0-9]+)\.json$"
INTEGRATED_SUFFIX = ".teacher.perception_integrated"


def base_name(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def strip_json(name) -> Column:
    """File name without ``.json``: the gold video id."""
    return F.regexp_replace(col(name), r"\.json$", "")


def student_stem(name) -> Column:
    """File name without the first matching answer suffix."""
    return F.regexp_replace(col(name), r"(_json_answer|_integrated)?\.json$", "")


def path_stem(path) -> Column:
    """Base name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def extension(path) -> Column:
    """Lower-case extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)\.([^.]+)$", 1))


def is_video(path, extensions) -> Column:
    return extension(path).isin(list(extensions))


def teacher_run_stem(name) -> Column:
    """Video id of a teacher-run file of either naming, NULL for other files."""
    stem = F.regexp_extract(col(name), TEACHER_RUN, 1)
    return F.when(stem != "", stem)


def raw_run(name) -> Column:
    """``struct<stem, run, digits, padding>`` of a raw teacher run, NULL for other files.

    ``padding`` counts leading zeros: ``run_01`` and ``run_1`` are both run 1. ``digits`` is the run
    number without them, of any length; ``run`` is the same as a number, NULL beyond 38 digits.
    """
    written = F.regexp_extract(col(name), RAW_RUN, 2)
    digits = F.regexp_replace(written, "^0+(?=[0-9])", "")
    return F.when(
        col(name).rlike(RAW_RUN),
        F.struct(
            F.regexp_extract(col(name), RAW_RUN, 1).alias("stem"),
            digits.try_cast("decimal(38,0)").alias("run"),
            digits.alias("digits"),
            (F.length(written) - F.length(digits)).alias("padding"),
        ),
    )


def model_from_stem(stem) -> Column:
    """Tokens after the last time token such as ``06m07s``; without one, or with
    nothing after it, the last token."""
    parts = F.split(col(stem), "_")
    is_time = F.transform(parts, lambda t: t.rlike("^[0-9]+m[0-9]+s$"))
    last = F.size(parts) - F.array_position(F.reverse(is_time), True) + 1
    found = F.array_contains(is_time, True) & (last < F.size(parts))
    return F.when(
        found, F.array_join(F.slice(parts, F.least(last + 1, F.size(parts)), F.size(parts)), "_")
    ).otherwise(F.element_at(parts, -1))


def sanitize(text) -> Column:
    """Safe file name: other characters become ``_``, outer ``._-`` go, never empty."""
    safe = F.regexp_replace(col(text), "[^A-Za-z0-9._-]+", "_")
    trimmed = F.regexp_replace(safe, "^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("result"))


def normalize_model(model) -> Column:
    return F.translate(col(model), "-", "_")


def result_name(media_path, model) -> Column:
    """Output file name of one (media, model) call."""
    return F.concat(
        sanitize(F.concat(F.lit("question_"), path_stem(media_path))),
        F.lit("_"),
        normalize_model(model),
        F.lit(".json"),
    )
