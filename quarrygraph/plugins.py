"""Plug-in points for what can't run inside the engine: language models and the network.

An extractor is a function from prompts to JSON texts.  The stand-ins are
deterministic, so pipelines and tests run without a network.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE_SCHEMA = (
    "document_summary string, themes array<string>, entities array<struct<name:string, entity_type:string, aliases:array<string>, confidence:double>>, "
    "relations array<struct<source_entity:string, relation_type:string, target_entity:string, scope_id:string, evidence_text:string, confidence:double>>"
)
RETRY_STATUS = (429, 500, 502, 503, 504)


class ModelError(RuntimeError):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def with_retries(call: Callable[[str], str], retries: int = 4, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Calls again after 429, 5xx and timeouts, waiting delay * 2^n."""

    def run(prompt: str) -> str:
        for n in range(retries + 1):
            try:
                return call(prompt)
            except (ModelError, TimeoutError) as e:
                if n == retries or (isinstance(e, ModelError) and e.status not in RETRY_STATUS):
                    raise
                sleep(delay * 2**n)
        raise AssertionError

    return run


def hashed_vector(dimensions: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for an embedding model: a vector from the text's hash."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            h = hashlib.sha256(t.encode()).digest()
            out.append([(h[i % 32] - 127.5) / 127.5 for i in range(dimensions)])
        return out

    return run


def ask_model(prompts: DataFrame, call: Callable[[str], str], prompt_col: str = "prompt") -> DataFrame:
    """Add the model's answers, parsed; an answer that isn't such JSON gives null."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return p.map(call)

    return prompts.withColumn("response", F.from_json(run(prompt_col), RESPONSE_SCHEMA))
