"""A remote chat-completions service as a labeler. Calls are not repeatable: store the labelled rows before using them twice."""

from __future__ import annotations

import http.client
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import llm_api


@dataclass(frozen=True)
class Service:
    """Where and how to call. At most ``tasks`` calls run at once in the whole job."""

    base_url: str
    key: str
    model: str = llm_api.DEFAULT_MODEL
    timeout: int = 300
    tasks: int = 5

    def __post_init__(self) -> None:
        if not self.base_url or not self.key:
            raise ValueError("a remote labeler needs a base URL and a key")


def call(url: str, body: str, service: Service) -> tuple[int, str, str | None]:
    """(status, body, request id); status 0 and the reason if there was no whole answer. One attempt, and no exception, since a task that fails calls again."""
    request = urllib.request.Request(url, body.encode(), {"Authorization": f"Bearer {service.key}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=service.timeout) as answer:
            return answer.status, answer.read().decode(), answer.headers.get("x-request-id")
    except urllib.error.HTTPError as e:
        try:
            text = e.read().decode(errors="replace")
        except (OSError, http.client.HTTPException) as broken:
            text = json.dumps({"error": {"message": f"{type(broken).__name__}: {broken}"}})
        return e.code, text, e.headers.get("x-request-id")
    except (OSError, ValueError, http.client.HTTPException) as e:
        return 0, json.dumps({"error": {"message": f"{type(e).__name__}: {e}"}}), None


def label(chunks: DataFrame, service: Service, keys: tuple[str, ...] = ("doc_id", "chunk_ix"), text: str = "chunk") -> DataFrame:
    """keys, labelled (null on failure), error (kind, message, type, code) and request_id of each chunk.

    An answer without content is an error too (kind empty). The service's request id is given where it sends one.
    """
    url = service.base_url.rstrip("/") + "/chat/completions"
    rows = chunks.select(*keys, llm_api.request(F.col(text), F.lit(service.model)).alias("_body")).repartition(service.tasks)
    kinds = dict(rows.dtypes)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [call(url, body, service) for body in batch["_body"]]
            yield batch[list(keys)].assign(_status=[a[0] for a in answers], _answer=[a[1] for a in answers], request_id=[a[2] for a in answers])

    sent = rows.mapInPandas(send, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _status int, _answer string, request_id string")
    good = F.col("_status").between(200, 299)
    sent = sent.withColumn("labelled", F.when(good, llm_api.answer(F.col("_answer"))))
    error = F.when(~good, llm_api.error(F.col("_answer"))).when(F.col("labelled").isNull(), llm_api.without_content(F.col("_answer")))
    return sent.select(*keys, "labelled", error.alias("error"), "request_id")
