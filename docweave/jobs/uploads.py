"""What an upload request answers: a JSON list with an entry for each named file, or an error where no file has a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.paths import result_name, upload_allowed


def entry(name: Column, markdown: Column) -> Column:
    """The entry of a named file: markdown is null or empty where its conversion failed."""
    allowed = upload_allowed(name)
    good = allowed & (F.length(F.coalesce(markdown, F.lit(""))) > 0)
    message = F.when(good, "done").when(allowed, "no result").otherwise("file type not allowed")
    return F.struct(name.alias("original_filename"), F.when(good, "success").otherwise("error").alias("status"), F.when(good, result_name(name)).alias("processed_filename"), message.alias("message"))


def replies(uploads: DataFrame) -> DataFrame:
    """(request, status, body) from (request, ix, filename, markdown), a row for each file of a request.

    Files keep their order, those without a name are left out, and processed_filename is absent where there is none. Failed files
    leave the status at 200; a request whose names are all empty gets 400. A task holds the names of one request, no texts.
    """
    named = F.length(F.coalesce("filename", F.lit(""))) > 0
    item = F.struct("ix", entry(F.col("filename"), F.col("markdown")).alias("entry"))
    rows = uploads.select("request", named.alias("_named"), F.when(named, item).alias("_item"))
    each = rows.groupBy("request").agg(F.bool_or("_named").alias("_any"), F.array_sort(F.collect_list("_item")).alias("_items"))
    body = F.when(F.col("_any"), F.to_json(F.transform("_items", lambda x: x["entry"]))).otherwise('{"error":"no file was chosen"}')
    return each.select("request", F.when(F.col("_any"), 200).otherwise(400).alias("status"), body.alias("body"))
