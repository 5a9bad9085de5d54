"""Bookkeeping of batch model calls: what is pending, what came back, what to store."""

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scenegrade.functions import json_docs as J
from scenegrade.functions import names as N
from scenegrade.functions.responses import first_json_object

CALL_RESULT = "response_text string, elapsed_s double, usage map<string,bigint>"


def _in_order(values) -> list:
    return list(dict.fromkeys(values))


def first_media(media: DataFrame, limit: int | None = None, samples: int | None = None) -> DataFrame:
    """First media in path order; ``samples`` overrides ``limit``."""
    n = samples if samples is not None else limit
    return media if n is None else media.orderBy("path").limit(n)


def planned_calls(media: DataFrame, models) -> DataFrame:
    """Every (media, model) call: the models are a short fixed list, emitted per media row."""
    listed = F.array(*[F.lit(m) for m in _in_order(models)])
    return media.withColumn("model", F.explode(listed)).withColumn("file_name", N.result_name("path", "model"))


def pending_calls(media: DataFrame, models, done: DataFrame) -> DataFrame:
    """Planned calls without a stored result. ``done``: ``path, model`` of the stored ones."""
    return planned_calls(media, models).join(done.select("path", "model"), ["path", "model"], "left_anti")


def planned_runs(media: DataFrame, runs: int) -> DataFrame:
    """Every teacher run of every media file, with its output name."""
    return media.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).withColumn(
        "file_name",
        F.concat(
            N.path_stem("path"), F.lit(".teacher.perception_raw.run_"), F.col("run").cast("string"), F.lit(".json")
        ),
    )


def _cleaned(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add ``<prefix>_text`` (object found in the text, else the text) and ``<prefix>_valid``."""
    found = F.coalesce(first_json_object(text), F.col(text))
    parsed = J.parse_documents(df.withColumn("_found", found), "_found")
    return parsed.select(
        *df.columns, F.col("_found").alias(f"{prefix}_text"), F.col("parse_ok").alias(f"{prefix}_valid")
    )


def choose_attempt(calls: DataFrame) -> DataFrame:
    """Result of a call from its first attempt and, where made, the stricter retry.

    ``first`` and ``retry`` are structs ``(response_text, elapsed_s, usage)``, NULL when
    the request failed. The first attempt wins when it holds a valid object; else the
    retry is taken, cleaned if valid and as it is otherwise; a failed retry leaves the
    first attempt.
    """
    df = calls.withColumn("_t1", F.col("first.response_text")).withColumn("_t2", F.col("retry.response_text"))
    df = _cleaned(_cleaned(df, "_t1", "_first"), "_t2", "_retry")
    first_valid = F.coalesce(F.col("_first_valid"), F.lit(False))
    use_retry = F.col("first").isNotNull() & ~first_valid & F.col("retry").isNotNull()
    text = (
        F.when(F.col("first").isNull(), F.lit(None).cast("string"))
        .when(first_valid, F.col("_first_text"))
        .when(F.col("retry").isNull(), F.col("_t1"))
        .when(F.coalesce(F.col("_retry_valid"), F.lit(False)), F.col("_retry_text"))
        .otherwise(F.col("_t2"))
    )
    used = F.when(use_retry, F.col("retry")).otherwise(F.col("first"))
    return df.select(
        *calls.columns,
        F.when(F.col("first").isNull(), F.lit("failed"))
        .when(use_retry, F.lit("retry")).otherwise(F.lit("first")).alias("attempt"),
        text.alias("response_text"),
        used.elapsed_s.alias("elapsed_s"),
        used.usage.alias("usage"),
    )


def call_outcomes(results: DataFrame) -> DataFrame:
    """Add ``status`` and the result ``document`` to finished calls.

    Reads ``response_text`` (NULL: no result) and ``exception`` (text of a raised error).
    """
    parsed = J.parse_documents(results, "response_text")
    empty = F.coalesce(F.col("response_text"), F.lit("")) == ""
    status = (
        F.when(F.col("exception").isNotNull(), F.lit("exception"))
        .when(empty, F.lit("inference_failed"))
        .when(~F.col("json_ok"), F.lit("json_parse_failed"))
        .otherwise(F.lit("ok"))
    )
    raw = F.coalesce(F.col("response_text"), F.lit(""))
    document = (
        F.when(
            F.col("status") == "exception",
            F.to_json(F.struct(F.concat(F.lit("exception: "), F.col("exception")).alias("error"))),
        )
        .when(F.col("status") == "ok", F.col("response_text"))
        .otherwise(F.to_json(F.struct(F.col("status").alias("error"), raw.alias("raw_text"))))
    )
    return (
        parsed.withColumn("status", status)
        .withColumn("document", document)
        .select(*results.columns, "status", "document")
    )


def run_outcomes(runs: DataFrame, model: str) -> DataFrame:
    """Teacher-run documents: ``path, run, file_name, document``.

    ``runs`` has ``path, run, file_name, response_text, error, stage, elapsed_s``. An upload
    failure is stored once, as run 1; other failures per run.
    """
    uploading = F.coalesce(F.col("stage") == "upload/activate", F.lit(False))
    upload_doc = F.to_json(
        F.struct(F.col("path").alias("video"), F.lit(model).alias("model"), F.col("stage"), F.col("error"))
    )
    run_doc = F.to_json(
        F.struct(
            "run", F.lit("perception_generate_or_parse").alias("stage"), "error", "elapsed_s",
        )
    )
    document = (
        F.when(uploading, upload_doc).when(F.col("error").isNotNull(), run_doc).otherwise(F.col("response_text"))
    )
    return runs.filter(~uploading | (F.col("run") == 1)).select(
        "path", "run", "file_name", document.alias("document")
    )


def token_usage(calls: DataFrame) -> DataFrame:
    """Token totals per model from the usage records."""

    def total(name):
        return F.sum(F.try_element_at("usage", F.lit(name))).alias(name)

    return calls.groupBy("model").agg(
        total("prompt_token_count"), total("candidates_token_count"), total("total_token_count")
    )


def _answer_path(answers: str, row, key) -> str:
    name = hashlib.sha256(json.dumps([str(row[k]) for k in key]).encode()).hexdigest()
    return f"{answers}/{name[:2]}/{name}.json"


def _stored_answer(system, path: str):
    from pyarrow import fs

    if system.get_file_info(path).type != fs.FileType.File:
        return None
    with system.open_input_file(path) as file:
        return json.loads(file.read())


def _store_answer(system, path: str, answer: dict) -> None:
    """Written under another name first: an answer is there whole or not at all."""
    system.create_dir(path.rpartition("/")[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(partial) as out:
        out.write(json.dumps(answer).encode())
    system.move(partial, path)


def batch_call(pending: DataFrame, model_call, partitions: int | None = None, answers: str | None = None, key=("path", "model")) -> DataFrame:
    """Run a user function over pending calls, one Arrow batch at a time.

    ``model_call(pandas.DataFrame) -> pandas.DataFrame`` returns ``response_text``,
    ``elapsed_s`` and ``usage`` for each row; it holds its own client. ``partitions``
    bounds how many calls run side by side.

    With ``answers``, a folder that all executors share, the answers of a batch are stored there under their call's ``key``
    before the task goes on. A task that is tried again, or another run over the same calls, reads them instead of
    calling again; only the calls of the batch that failed are repeated.
    """
    spread = pending if partitions is None else pending.repartition(partitions)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pending.schema.fields)
    columns = ["response_text", "elapsed_s", "usage"]

    def answered(batch):
        if answers is None:
            return model_call(batch)[columns]
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(answers if ":/" in answers else "file://" + answers)
        paths = [_answer_path(folder, row, key) for row in batch.to_dict("records")]
        known = [_stored_answer(system, path) for path in paths]
        open_calls = [k for k, answer in enumerate(known) if answer is None]
        if open_calls:
            made = model_call(batch.iloc[open_calls].reset_index(drop=True))[columns].to_dict("records")
            for k, answer in zip(open_calls, made):
                known[k] = {**answer, "usage": None if answer["usage"] is None else {n: int(v) for n, v in dict(answer["usage"]).items()}}
                _store_answer(system, paths[k], known[k])
        return pd.DataFrame(known, columns=columns)

    def run(batches):
        for batch in batches:
            got = answered(batch)
            yield batch.assign(**{c: got[c].to_numpy() for c in columns})

    return spread.mapInPandas(run, f"{fields}, {CALL_RESULT}")
