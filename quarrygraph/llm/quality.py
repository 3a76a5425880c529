"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over the whole text, and their responses
are max-pooled over overlapping chunks.  A chunk's pooled responses give its
logit; a document's chunks are combined (mean, greatest, least) into one
probability.  Network and combination are trained on bounded samples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import byte_chunks, text_bytes
from .common import crc_mod, table
from .labelled import HELD_OUT, logistic, sigmoid, training_rows

EMBED, WIDTH, STRIDE, FILTERS = 4, 8, 2, 24
#: Bytes of a pooling block; a chunk is CHUNK blocks and the next starts half a chunk later.
BLOCK, CHUNK = 64, 4
#: The bound of the training sample: documents of each label.
PER_LABEL = 700


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH*EMBED x FILTERS
    bias: np.ndarray
    head: np.ndarray  # FILTERS
    head_bias: float
    combine: np.ndarray | None = None

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Max-pooled responses of each block of ``data`` (whole blocks; WIDTH more bytes follow)."""
        x = self.embed[data]
        w = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0)[: len(data) - WIDTH : STRIDE].transpose(0, 2, 1).reshape(-1, WIDTH * EMBED)
        return (w @ self.filters).reshape(-1, BLOCK // STRIDE, FILTERS).max(axis=1) + self.bias


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each in an even number of blocks with at least WIDTH zero bytes after it, and pairs of blocks of each.

    A pair of empty blocks follows each text, so that no filter sees two texts.
    """
    size = np.diff(offsets)
    pairs = -(-(size + WIDTH) // (2 * BLOCK))
    start = np.concatenate([[0], np.cumsum(pairs + 1)]) * 2 * BLOCK
    out = np.zeros(start[-1] + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(start[:-1] - offsets[:-1], size)] = data
    return out, pairs


def document_features(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: mean and greatest pooled responses, and mean, greatest, least of its chunks' logits."""
    buf, pairs = padded(data, offsets)
    step = 2 * BLOCK * 1024
    pooled = np.concatenate([net.responses(buf[i : min(i + step, len(buf) - WIDTH) + WIDTH]) for i in range(0, len(buf) - WIDTH, step)])
    own = np.ones(len(pooled) // 2, bool)
    own[np.cumsum(pairs + 1) - 1] = False
    pair = np.maximum(pooled[::2], pooled[1::2])[own]
    first = np.concatenate([[0], np.cumsum(pairs)])[:-1]
    chunk = np.maximum(pair, np.concatenate([pair[1:], pair[-1:]]))
    last = first + pairs - 1
    chunk[last] = np.where((pairs > 1)[:, None], chunk[np.maximum(last - 1, 0)], pair[last])  # no chunk starts at a text's last pair
    chunk = np.maximum(chunk, 0)
    logit = chunk @ net.head + net.head_bias
    mean = np.add.reduceat(chunk, first, axis=0) / pairs[:, None]
    return np.hstack([mean, np.maximum.reduceat(chunk, first, axis=0), np.stack([np.add.reduceat(logit, first) / pairs, np.maximum.reduceat(logit, first), np.minimum.reduceat(logit, first), np.log1p(np.diff(offsets))], axis=1)])


def fit(chunks: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, seed: int = 3) -> Network:
    """Back-propagation with Adam; ``chunks`` are CHUNK*BLOCK + WIDTH bytes each."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "w": rng.normal(0, 0.25, (WIDTH * EMBED, FILTERS)), "b": np.zeros(FILTERS), "h": rng.normal(0, 0.2, FILTERS), "c": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["e"][0] = 0
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    t = 0
    for _ in range(epochs if len(chunks) and len(set(y.tolist())) > 1 else 0):
        for part in np.array_split(rng.permutation(len(chunks)), max(1, len(chunks) // batch)):
            xb, yb = chunks[part], y[part]
            x = p["e"][xb]
            win = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, : CHUNK * BLOCK : STRIDE].transpose(0, 1, 3, 2).reshape(len(part), -1, WIDTH * EMBED)
            z = win @ p["w"]
            at = z.argmax(axis=1)
            pooled = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + p["b"]
            act = np.maximum(pooled, 0)
            g = (sigmoid(act @ p["h"] + p["c"]) - yb) / len(part)
            gp = g[:, None] * p["h"] * (pooled > 0)
            best = win[np.arange(len(part))[:, None], at]  # batch x FILTERS x WIDTH*EMBED
            grad = {"h": act.T @ g, "c": g.sum(keepdims=True), "b": gp.sum(axis=0), "w": np.einsum("bf,bfk->kf", gp, best)}
            gx = (gp[:, :, None] * p["w"].T[None]).reshape(-1, EMBED)
            bytes_at = xb[np.arange(len(part))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1)
            grad["e"] = np.stack([np.bincount(bytes_at, gx[:, j], minlength=256) for j in range(EMBED)], axis=1)
            grad["e"][0] = 0
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v2[k] = 0.999 * v2[k] + 0.001 * grad[k] ** 2
                p[k] = (p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return Network(p["e"], p["w"], p["b"], p["h"], float(p["c"][0]))


def all_chunks(text: bytes) -> list[bytes]:
    """The overlapping chunks that ``document_features`` pools over, the last one filled up, each with WIDTH more bytes."""
    size, step = CHUNK * BLOCK, CHUNK * BLOCK // 2
    starts = range(0, max(1, len(text) - step), step)
    return [text[s : s + size].ljust(size, b"\0") + b"\0" * WIDTH for s in starts]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> tuple[Network, float]:
    """The network with its combination, and the share of label 1.  Without both labels, the score is that share.

    Filters and combination learn from all chunks of the sampled texts.
    """
    rows, counts = training_rows(docs, labels, label, per_label, id_col, text_col)
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    got = sorted(rows.collect(), key=lambda r: (r["k"], r["text"]))  # bounded by per_label and SAMPLE_BYTES
    y = np.array([r["label"] for r in got])
    texts = [bytes(r["text"]) for r in got]
    chunks = [all_chunks(t) for t in texts]
    many = np.repeat(y, [len(c) for c in chunks]).astype(np.float32)
    net = fit(np.frombuffer(b"".join(x for c in chunks for x in c), np.uint8).reshape(len(many), CHUNK * BLOCK + WIDTH), many)
    if len(set(y.tolist())) < 2:
        return net, prior
    x = np.concatenate([document_features(net, data, offsets) for _, _, data, offsets in byte_chunks(pa.array(texts, pa.binary()))]).astype(np.float64)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    weight = np.array([counts[k] / (y == k).sum() for k in y])  # the sample is even, the labels aren't
    w = logistic((x - mean) / std, y, weight)
    net.combine = np.concatenate([w[:-1] / std, [w[-1] - (w[:-1] * mean / std).sum()]])
    return net, prior


def score(df: DataFrame, model: tuple[Network, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and score.  Null texts score as empty ones."""
    net, prior = model
    rows = df.select(F.col(id_col).alias("_qg_id"), text_bytes(text_col).alias("_qg_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for i, j, data, offsets in byte_chunks(batch.column(1)):
                out.append(np.full(j - i, prior) if net.combine is None else sigmoid(document_features(net, data, offsets) @ net.combine[:-1] + net.combine[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], ["_qg_id", "score"])

    return rows.mapInArrow(run, f"_qg_id {df.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("_qg_id", id_col)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; null scores as empty, repeated rows score alike, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
