"""Requests to a chat-completions service, its answers and its errors, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import strip

DEFAULT_MODEL = "qwen-plus"
PROMPT = "Label every line of the text as a heading (H1, H2, H3, H4) or a paragraph (P). Answer with one line per item in the form 'LABEL: content' and with nothing else."


def endpoint(base: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/chat/completions"))


def request(text: Column, model: Column | None = None, prompt: str = PROMPT) -> Column:
    """JSON body of a request."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    of = F.coalesce(F.nullif(model, F.lit("")), F.lit(DEFAULT_MODEL)) if model is not None else F.lit(DEFAULT_MODEL)
    return F.to_json(F.struct(of.alias("model"), F.array(message("system", F.lit(prompt)), message("user", text)).alias("messages")))


def answer(body: Column) -> Column:
    """The stripped content of the first choice; null where there is none or it is empty. Blank content gives the empty string."""
    return strip(F.nullif(F.get_json_object(body, "$.choices[0].message.content"), F.lit("")))


def error(body: Column) -> Column:
    """(kind, message, type, code) of an error body: nested, flat or raw."""
    get = lambda path: F.get_json_object(body, path)
    nested, flat = get("$.error.message"), get("$.message")
    none = F.lit(None).cast("string")

    def row(kind: str, message: Column, type_: Column, code: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"), type_.alias("type"), code.alias("code"))

    return (
        F.when(nested.isNotNull(), row("nested", nested, get("$.error.type"), get("$.error.code")))
        .when(get("$.code").isNotNull() & flat.isNotNull(), row("flat", flat, none, get("$.code")))
        .otherwise(row("raw", body, none, none))
    )


def without_content(body: Column) -> Column:
    """The same fields for a good answer that has no content."""
    none = F.lit(None).cast("string")
    return F.struct(F.lit("empty").alias("kind"), F.concat(F.lit("answer without content: "), F.left(body, F.lit(500))).alias("message"), none.alias("type"), none.alias("code"))


def positive_int(value: Column, default: int) -> Column:
    """A setting read as text: its integer if positive, else the default."""
    number = value.try_cast("long")
    return F.when(number > 0, number).otherwise(F.lit(default).cast("long"))
