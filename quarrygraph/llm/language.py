"""Language ID by error-correcting output codes.

Each language has a codeword.  For each bit, a logistic classifier over hashed
byte trigrams of the whole text predicts it.  Decoding picks the language whose
codeword has the least summed logistic loss against the bits' margins, and flags
texts whose best two codewords lie close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import LOWER_BYTE, byte_chunks, sampled, text_bytes
from .common import crc_mod, table

DIMS = 4096
#: Training documents of each language and of all together: the bounds of the sample.
PER_LANGUAGE, IN_ALL = 600, 6000
#: A text is ambiguous if its best language has less than this share.
AMBIGUOUS = 0.7
UNKNOWN = "und"

#: Bytes as the trigrams see them: letters lower, everything else in ASCII a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x41:0x5B] = LOWER_BYTE[0x41:0x5B]
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, a row for each text."""
    n = len(offsets) - 1
    rows = np.zeros((n, DIMS), np.float32)
    if len(data) >= 3:
        x = _FOLD[data].astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))[:-2]
        inside = np.arange(len(h)) + 3 <= offsets[1:][doc]
        inside &= (x[:-2] != 32) | (x[1:-1] != 32)
        rows = np.bincount((doc[inside] * DIMS) + h[inside], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    total = rows.sum(axis=1, keepdims=True)
    return np.sqrt(rows / np.maximum(total, 1))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    count = np.concatenate([[0], np.cumsum(_LETTER[data])])
    found = count[offsets[1:]] > count[offsets[:-1]]
    for k in np.flatnonzero(~found):
        part = data[offsets[k] : offsets[k + 1]]
        if (part >= 0x80).any():
            found[k] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "ignore"))
    return found


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """+1/-1 rows: every split of up to 5 classes, else the random code with the widest least distance."""
    if classes <= 5:
        bits = max(1, 2 ** (classes - 1) - 1)
        return np.array([[1 if k == 0 or ~b >> (k - 1) & 1 else -1 for b in range(1, bits + 1)] for k in range(classes)])
    rng, best, width = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(classes)))
    for _ in range(200):
        code = rng.choice([-1, 1], (classes, bits))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        least = min(int((code[i] != code[j]).sum()) for i in range(classes) for j in range(i))
        if least > width:
            best, width = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMS x bits
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share."""
        margin = x @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margin * c).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, p[np.arange(len(x)), best]


def fit(x: np.ndarray, labels: list[str], rounds: int = 150, l2: float = 1e-5) -> Model:
    """Logistic regressions for all bits at once, by Nesterov steps."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    place = {k: i for i, k in enumerate(languages)}
    y = code[[place[k] for k in labels]].astype(np.float32) if labels else np.zeros((0, code.shape[1] if len(code) else 1), np.float32)
    w = np.zeros((DIMS, y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    if len(languages) > 1:
        mean = x.mean(axis=0)
        x = x - mean
        step = 4.0 / float(np.linalg.norm(x, axis=1).max() ** 2 + 1)
        v, vb = w.copy(), b.copy()
        for t in range(rounds):
            g = -y / (1 + np.exp(y * (x @ v + vb))) / len(x) * 8
            nw, nb = v - step * (x.T @ g + l2 * v), vb - step * g.sum(axis=0)
            m = t / (t + 3)
            v, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
        b = b - mean @ w
    return Model(languages, code, w, b)


def train(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Fit on about ``per_language`` documents of each language, fewer with many languages, so that the driver
    gets some ``in_all`` rows of features (50 MB) at most; rows without a language teach nothing."""
    known = df.filter(F.col(lang_col).isNotNull()).select(id_col, lang_col, text_col)
    rows = sampled(known, lang_col, id_col, per_language, in_all)
    rows = rows.select(F.col(lang_col).alias("label"), text_bytes(text_col).alias("text"), F.xxhash64(id_col).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in byte_chunks(batch.column(1)):
                out += [r.tobytes() for r in features(data, offsets).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["label", "x", "k"])

    got = sorted(rows.mapInArrow(run, "label string, x binary, k bigint").collect(), key=lambda r: (r["k"], r["label"]))
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float16).reshape(-1, DIMS).astype(np.float32)
    return fit(x, [r["label"] for r in got])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, ambiguous.

    A null text, one without a letter, and any text when nothing was learned are
    ``und`` with score 0.
    """
    rows = df.select(F.col(id_col).alias("_qg_id"), text_bytes(text_col).alias("_qg_text"))
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, share = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in byte_chunks(batch.column(1)):
                known = has_letter(data, offsets) if model.languages else np.zeros(len(offsets) - 1, bool)
                k, p = model.decode(features(data, offsets)) if model.languages else (np.zeros(len(known), int), np.zeros(len(known)))
                best.append(np.where(known, k, -1))
                share.append(np.where(known, p, 0.0))
            k, p = np.concatenate(best), np.concatenate(share).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[k], pa.string()), pa.array(p), pa.array(p < AMBIGUOUS)], ["_qg_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"_qg_id {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("_qg_id", id_col)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; null and texts without a letter are ``und``, repeated rows alike, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = train(docs.filter(~held_out))
    return predict(docs.select("doc_id", "text"), model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
