"""Toxicity: a linear-chain conditional random field over words.

Word labels come from document labels: a word of a toxic document is toxic if
its stem (or the word) stands in toxic documents far more often than in others.
On these the field is trained; its forward-backward marginals tag spans, and
what they sum to gives the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import LOWER_BYTE, WORD_BYTE, byte_chunks, text_bytes, word_starts
from .common import crc_mod, table
from .labelled import HELD_OUT, logistic, sigmoid, training_rows

DIMS = 1 << 20
#: The bound of the training sample: documents of each label.
PER_LABEL = 900
#: The field learns from chains of this many words; a text is cut into such chains, and all of them teach.
STRETCH = 128
#: A feature marks words as toxic from this many toxic documents on, from this smoothed share, and only
#: if so many would be this many standard deviations off were it independent of the label.
SUPPORT, SHARE, DEVIATIONS = 3, 0.8, 4.5
#: A word's marginal from which it is part of an offending span.
OFFENDING = 0.5
#: Texts are worked on together, so that steps along the chains are shared.
TOGETHER_BYTES, TOGETHER_ROWS = 1 << 22, 4096
_PREFIXES = (4, 5, 6, 7, 8)
FEATURES = 2 + len(_PREFIXES)
#: Runs of more bytes, or of over PIECE bytes in scripts whose characters take three, are cut into overlapping pieces.
RUN, PIECE = 32, 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) with each long run replaced by what fits in PIECE bytes from each of its characters on."""
    wide = np.flatnonzero(data >= 0xE0)
    long = (ends - starts > RUN) | ((ends - starts > PIECE) & (np.searchsorted(wide, ends) > np.searchsorted(wide, starts)))
    if not long.any():
        return starts, ends
    a, b = starts[long], ends[long]
    step = np.zeros(len(data) + 1, np.int8)
    step[a] += 1
    step[b] -= 1
    lead = (data & 0xC0) != 0x80
    lead[a] = True
    at = np.flatnonzero((np.cumsum(step, dtype=np.int8)[:-1] > 0) & lead)
    run = np.searchsorted(a, at, "right") - 1
    stop = np.minimum(at + PIECE, b[run])
    for _ in range(3):  # back to the end of a character
        stop -= (stop < b[run]) & ~lead[np.minimum(stop, len(data) - 1)]
    fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (stop[:-1] < b[run[:-1]])])
    at, stop = np.concatenate([starts[~long], at[fresh]]), np.concatenate([ends[~long], stop[fresh]])
    order = np.argsort(at, kind="stable")
    return at[order], stop[order]


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text, hashed features by word): word, prefixes of 4 to 8 bytes, last 3 bytes.

    Words are told apart by all of their bytes; long runs are cut by ``pieces``; the capitals of Latin-1 are lower.
    """
    starts = word_starts(data, offsets)
    word = WORD_BYTE[data]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = word[edge]
    starts, ends = pieces(data, starts, np.flatnonzero(last) + 1)
    buf = np.zeros(len(data) + 24, np.uint8)
    buf[3 : 3 + len(data)] = LOWER_BYTE[data]
    # the capitals of Latin-1 in UTF-8, too: C3 80 to C3 9E without the multiplication sign
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    buf[3 + capital] += 0x20
    eight = np.ndarray((len(data) + 16,), "<u8", buf, strides=(1,))

    def head(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        shift = np.uint64(64) - np.uint64(8) * np.clip(n, 1, 8).astype(np.uint64)
        return np.where(n > 0, (eight[at + 3] << shift) >> shift, np.uint64(0))

    signed = ends - starts
    whole = signed.astype(np.uint64)
    for k in range(0, RUN, 8):  # no word is longer
        whole = _mix(head(np.minimum(starts + k, len(data)), signed - k) * np.uint64(0xD6E8FEB86659FD93) + whole)
    out = [whole]
    out += [_mix(head(starts, np.minimum(signed, k)) * np.uint64(31) + np.uint64(k)) for k in _PREFIXES]
    out.append(_mix((head(ends - np.minimum(signed, 3), np.minimum(signed, 3)) << np.uint64(8)) + np.uint64(255)))
    hashed = (np.stack(out, axis=1) >> np.uint64(32)).astype(np.int64)
    return starts, ends, np.searchsorted(starts, offsets), (hashed % (DIMS // FEATURES)) * FEATURES + np.arange(FEATURES)


@dataclass
class Field:
    """Scores of state 1 over state 0; ``step[i, j]``: of going from state i to j; ``start``: of state 1 at first."""

    emit: np.ndarray
    bias: float
    step: np.ndarray
    start: float
    combine: np.ndarray | None = None

    def emission(self, features: np.ndarray) -> np.ndarray:
        out = np.full(len(features), self.bias)
        for k in range(FEATURES):  # column by column: no array of words x features
            out += self.emit[features[:, k]]
        return out


def marginals(field: Field, emission: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probability of state 1 of each word, by forward-backward along all texts at once.

    ``at``: where each text's words begin, and the end.  Only the log ratio of the
    two states is carried; texts leave as they end, so time goes as the words.
    """
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    first, size = at[:-1][order], size[order]
    s = field.step
    alpha = np.empty(len(emission))
    beta = np.zeros(len(emission))
    live = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")
    r = np.full(len(size), field.start)
    for t, k in enumerate(live):
        if t:
            r = np.logaddexp(r[:k] + s[1, 1], s[0, 1]) - np.logaddexp(r[:k] + s[1, 0], s[0, 0])
        i = first[:k] + t
        r = r[:k] + emission[i]
        alpha[i] = r
    r = np.zeros(0)
    for t in range(len(live) - 2, -1, -1):
        k = live[t + 1]  # the texts that have a next word
        i = first[:k] + t + 1
        x = beta[i] + emission[i]
        beta[i - 1] = np.logaddexp(x + s[1, 1], s[1, 0]) - np.logaddexp(x + s[0, 1], s[0, 0])
    return sigmoid(alpha + beta)


def fit(f: np.ndarray, y: np.ndarray, at: np.ndarray, rounds: int = 60) -> Field:
    """Gradient steps (Adagrad) on the likelihood of the chains' labels; ``at``: where each chain begins, and the end."""
    lab = y.astype(float)
    field = Field(np.zeros(DIMS), -2.0, np.zeros((2, 2)), -2.0)
    sums = {k: 1e-8 for k in ("emit", "bias", "step", "start")}
    inner = np.ones(len(lab), bool)
    inner[at[:-1][at[:-1] < len(lab)]] = False
    pairs = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (lab[pairs - 1].astype(int), lab[pairs].astype(int)), 1)
    begins = at[:-1]
    for _ in range(rounds):
        e = field.emission(f)
        p = marginals(field, e, at)
        # pair marginals, with neighbours' odds from the single ones by the chain's conditional form
        q1, q0 = field.step[1, 1] - field.step[1, 0], field.step[0, 1] - field.step[0, 0]
        prior, post = p[pairs - 1], p[pairs]
        odds = np.log(np.clip(post, 1e-12, 1 - 1e-12)) - np.log(np.clip(1 - post, 1e-12, 1))
        p11 = _pair(prior, odds, q1, q0)
        expect = np.array([[(1 - prior - post + p11).sum(), (post - p11).sum()], [(prior - p11).sum(), p11.sum()]])
        d = lab - p
        grad = {"emit": sum(np.bincount(f[:, k], d, DIMS) for k in range(FEATURES)), "bias": d.sum(), "step": seen - expect, "start": d[begins].sum()}
        for k, g in grad.items():
            sums[k] = sums[k] + g * g
            setattr(field, k, getattr(field, k) + 0.3 * g / np.sqrt(sums[k]) - (1e-4 * field.emit if k == "emit" else 0))
    field.emit, field.bias, field.start = field.emit.astype(np.float32), float(field.bias), float(field.start)
    return field


def _pair(prior: np.ndarray, odds: np.ndarray, q1: float, q0: float) -> np.ndarray:
    """P(1, 1) of neighbours with P(1, .) = prior and log odds of P(., 1) = odds, whose log odds ratio is q1 - q0."""
    post = sigmoid(odds)
    k = np.exp(np.clip(q1 - q0, -20, 20))
    if abs(k - 1) < 1e-6:
        return prior * post
    b = 1 + (k - 1) * (prior + post)
    return np.clip((b - np.sqrt(np.maximum(b * b - 4 * k * (k - 1) * prior * post, 0))) / (2 * (k - 1)), 0, np.minimum(prior, post))


def token_labels(f: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic texts that a feature marks; a feature counts once a text (``at``: where each begins)."""
    bad, good = np.zeros(DIMS), np.zeros(DIMS)
    for a, b, y in zip(at[:-1], at[1:], toxic, strict=True):
        (bad if y else good)[np.unique(f[a:b])] += 1
    scale = max(1, (toxic == 0).sum()) / max(1, (toxic == 1).sum())
    share = (bad * scale) / (bad * scale + good + 0.5)
    part = (toxic == 1).mean()
    off = (bad - (bad + good) * part) / np.sqrt(np.maximum((bad + good) * part * (1 - part), 1e-9))
    marks = (bad >= SUPPORT) & (share >= SHARE) & (off >= DEVIATIONS)
    hit = np.zeros(len(f), bool)
    for k in range(FEATURES):
        hit |= marks[f[:, k]]
    return hit & np.repeat(toxic == 1, np.diff(at))


def document_features(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: greatest marginal (log odds), expected toxic words and their rate (logs), words over OFFENDING, length."""
    n = np.diff(at)
    some = n > 0
    out = np.zeros((len(n), 5))
    out[:, 0] = -9
    out[:, 3] = np.log(0.1 / (n + 20))
    out[:, 4] = np.log1p(n)
    if some.any():
        first = at[:-1][some]
        top = np.clip(np.maximum.reduceat(p, first), 1e-4, 1 - 1e-4)
        hits = np.add.reduceat((p >= OFFENDING).astype(float), first)
        strong = np.add.reduceat(np.where(p >= 0.05, p, 0), first)
        out[some, :4] = np.stack([np.log(top / (1 - top)), np.log1p(strong), np.log1p(hits), np.log((strong + 0.1) / (n[some] + 20))], axis=1)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_label: int = PER_LABEL) -> tuple[Field | None, float]:
    """The field with its combination, and the share of label 1; no field without both labels."""
    rows, counts = training_rows(docs, labels, label, per_label, id_col, text_col)
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.0
    if not (counts.get(0) and counts.get(1)):
        return None, prior

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in byte_chunks(batch.column(1)):
                _, _, at, f = word_features(data, offsets)
                out += [f[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["label", "x", "k"])

    got = rows.mapInArrow(cut, "label int, x binary, k bigint").toArrow()
    order = sorted(range(len(got)), key=lambda i: (got["k"][i].as_py(), got["x"][i].as_py()))
    toxic = got["label"].to_numpy()[order]
    size = pa.compute.binary_length(got["x"]).to_numpy()[order] // (4 * FEATURES)
    at = np.concatenate([[0], np.cumsum(size)])
    f = np.empty((int(at[-1]), FEATURES), np.int32)
    for a, i, n in zip(at, order, size, strict=False):
        f[a : a + n] = np.frombuffer(got["x"][i].as_buffer(), "<i4").reshape(-1, FEATURES)
    del got
    if not (0 < toxic.sum() < len(toxic)) or not len(f):
        return None, prior
    y = token_labels(f, at, toxic)
    chains = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(at[:-1], at[1:], strict=True)] + [at[-1:]])
    field = fit(f, y, chains)
    x = document_features(marginals(field, field.emission(f), at), at)
    weight = np.array([counts[k] / (toxic == k).sum() for k in toxic])  # the sample is even, the labels aren't
    field.combine = logistic(x, toxic, weight, l2=1e-4)
    return field, prior


def tag(df: DataFrame, model: tuple[Field | None, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, and the offending spans (byte offsets of runs of words, and their peak).

    Null texts score as empty ones.
    """
    field, prior = model
    rows = df.select(F.col(id_col).alias("_qg_id"), text_bytes(text_col).alias("_qg_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def found(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
        hit = np.flatnonzero(p >= OFFENDING)
        own = np.searchsorted(at, hit, "right") - 1
        previous = -2
        for i, k in zip(hit.tolist(), own.tolist(), strict=True):
            if i == previous + 1 and out[k]:
                out[k][-1]["end"] = int(ends[i] - offsets[k])
                out[k][-1]["marginal"] = max(out[k][-1]["marginal"], float(p[i]))
            else:
                out[k].append({"start": int(starts[i] - offsets[k]), "end": int(ends[i] - offsets[k]), "marginal": float(p[i])})
            previous = i
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, lists = [np.zeros(0)], []
            for i, j, data, offsets in byte_chunks(batch.column(1), TOGETHER_BYTES, TOGETHER_ROWS):
                if field is None:
                    scores.append(np.full(j - i, prior))
                    lists += [[]] * (j - i)
                    continue
                starts, ends, at, f = word_features(data, offsets)
                p = marginals(field, field.emission(f), at)
                scores.append(sigmoid(document_features(p, at) @ field.combine[:-1] + field.combine[-1]))
                lists += found(p, starts, ends, at, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores), pa.float64()), pa.array(lists, kind)], ["_qg_id", "score", "spans"])

    return rows.mapInArrow(run, f"_qg_id {df.schema[id_col].dataType.simpleString()}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>").withColumnRenamed("_qg_id", id_col)


def reject_toxic(docs: DataFrame, model: tuple[Field | None, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay, whatever their names and nulls.

    A model that has seen one label only can't tell rows apart, so it rejects none.
    """
    field, _ = model
    if field is None:
        return docs

    @F.pandas_udf("double")
    def toxic(texts):
        column = pa.array(texts, pa.binary())
        out = [np.zeros(0)]
        for _, _, data, offsets in byte_chunks(column, TOGETHER_BYTES, TOGETHER_ROWS):
            _, _, at, f = word_features(data, offsets)
            out.append(sigmoid(document_features(marginals(field, field.emission(f), at), at) @ field.combine[:-1] + field.combine[-1]))
        import pandas as pd

        return pd.Series(np.concatenate(out))

    return docs.filter(toxic(text_bytes(text_col)) < threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, with the offending spans; null scores as empty, repeated rows score alike, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
