"""Small documents with the odd cases, and DuckDB over the driver's tables."""

from __future__ import annotations

import os
import random

DATA = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _extra string, fingerprint string, label int, a int, key string"


def docs(spark, texts, ids=None, **cols):
    """A documents table with extra columns whose names an operator might use itself."""
    ids = list(range(len(texts))) if ids is None else ids
    lang, source = cols.get("lang", ["en"] * len(texts)), cols.get("source", ["s"] * len(texts))
    rows = [(i, t, g, s, len(t or ""), "x", "f", 1, 2, "k") for i, t, g, s in zip(ids, texts, lang, source, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng: random.Random, n: int) -> str:
    """Words of invented syllables, none of which repeats by chance."""
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "zu", "dar", "fen", "gol", "hem"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


ODD = [None, "", " \n\t ", "a", "A", "é", "́", "one two", "x" * 5000, "12 34", "日本語 テキスト", "same same same same same", "same same same same same"]
