"""Model stages whose results are kept: an input that a model has answered isn't asked again."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetflow.functions.expressions import description_error
from assetflow.sources.files import exists
from assetflow.streaming.progress import state_folder, stored

from .providers import run

_ANSWER = ["result", "status", "error", "attempts"]


def answered(rows: DataFrame, column: str, names: list[str], kind: str = "string", options: dict | None = None, retries: int = 2, folder: str | None = None, version: str = "", described: Column | None = None) -> DataFrame:
    """rows with result, status, error and attempts, as providers.run() gives them, each distinct input asked once.

    A key of the input, the providers' names and options, and a version (of the prompt, say) stands for a result.  Inputs whose
    key the folder holds are joined with what was answered then; the others are asked, each text once however often it
    stands there, and written to the folder before anything reads them.  So neither several outputs of one
    stage, nor a lost executor once the stage is written, nor a later run asks a model again.  Only successes are
    remembered; failures are told, and asked anew by the next run.  Without a folder the results serve this call alone.

    With described, each row's kind, an answer must also pass the checks of descriptions (validated()).  A null input is an
    input of its own; repeated rows share its answer; columns named like the new ones are replaced.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in _ANSWER]
    folder = folder or state_folder(spark, "answers")
    about = F.lit(json.dumps([names, options or {}, version, described is not None], sort_keys=True))
    text = F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))
    keyed = rows.select(*(F.col(f"`{c}`") for c in kept)).withColumn("__kind", F.coalesce(described, F.lit("")) if described is not None else F.lit(""))
    keyed = keyed.withColumn("__key", F.sha2(F.concat_ws("\u001f", about, "__kind", text), 256))
    schema = StructType.fromDDL(f"__key string, result {kind}, status string, error string, attempts int")
    known = spark.read.schema(schema).parquet(f"{folder}/answers") if exists(spark, f"{folder}/answers") else spark.createDataFrame([], schema)
    asked = keyed.groupBy("__key").agg(F.first(F.col(f"`{column}`")).alias("text"), F.first("__kind").alias("kind")).join(known.select("__key"), "__key", "left_anti")
    if described is None:
        made = run(asked, "text", names, kind, options, retries=retries)
    else:
        made = validated(asked, names, options, retries)
    made = stored(made.select("__key", *_ANSWER), "answered")
    made.where("status = 'ok'").write.mode("append").parquet(f"{folder}/answers")
    return keyed.join(known.unionByName(made), "__key").select(*(F.col(f"`{c}`") for c in kept), *_ANSWER)


def validated(rows: DataFrame, names: list[str], options: dict | None = None, retries: int = 2) -> DataFrame:
    """rows (text, kind) with result, status, error and attempts: descriptions that pass the checks of format, length and keywords of their kind.

    What a provider raises, and what doesn't pass, goes to it again, up to retries more times, and then to the next
    provider; each round asks for the rows still open alone, and ends early without any.  A row that none
    serves has a null result and its last error, code and message parted by "|": PROVIDER_ERROR, or that of the check.
    """
    done, opened, n = None, stored(rows.withColumn("error", F.lit(None).cast("string")), "open"), 0
    for name in names:
        for _ in range(retries + 1):
            if not opened.limit(1).count():
                break
            n += 1
            tried = run(opened.drop("error"), "text", [name], "string", options, retries=0).drop("attempts")
            wrong = description_error(F.col("result"), F.col("kind"))
            error = (
                F.when(F.col("status") == "failed", F.concat(F.lit("PROVIDER_ERROR|"), "error")).when(F.col("result").isNull(), "PROVIDER_ERROR|no description")
                .otherwise(F.concat_ws("|", wrong["code"], wrong["message"])))
            tried = stored(tried.withColumn("error", F.nullif(error, F.lit(""))).withColumn("attempts", F.lit(n)), "tried")
            passed = tried.where("status = 'ok' and error is null")
            done = passed if done is None else done.unionByName(passed)
            opened = tried.where("status = 'failed' or error is not null").select(*rows.columns, "error")
    lost = opened.withColumns({"result": F.lit(None).cast("string"), "status": F.lit("failed"), "attempts": F.lit(n)})
    return lost if done is None else done.unionByName(lost)
