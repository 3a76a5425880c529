"""The registered queries on small tables: brute force where SQL has no word, odd rows, repeated rows, empty tables."""

import bisect
import hashlib
import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import batches, language, licenses, lines, quality, toxicity
from quarrygraph.llm.common import table
from quarrygraph.llm.registry import ORACLE_SQL, QUERIES

from .helpers import DATA, ODD, docs, prose
from .test_native import edited_brute, contamination_brute  # noqa: F401


def tables(spark, folder, rows, items=(), labels=()):
    """A folder of documents, benchmark, labels and a vector for each document; ``rows``: (doc_id, text, lang, source)."""
    vectors = [(i, [len(t or "") / 7 - k for k in range(16)], None if t is None else len(t) % 3) for i, t, _, _ in rows]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, tables(spark, tmp_path, [])).count() == 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_repeated_rows(spark, tmp_path, name):
    rng = random.Random(1)
    texts = [*ODD, prose(rng, 300), "wörter " * 20_000]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(3, "a", "en", "s"), (len(ODD), texts[len(ODD)], None, None), (None, "no id", "fr", None), (None, None, None, None)]
    out = QUERIES[name](spark, tables(spark, tmp_path, rows, [(1, prose(rng, 30)), (2, None)], [(i, i % 2, (i + 1) % 2) for i in range(10)] + [(3, None, None)]))
    n = out.count()
    assert n == len(rows) or name == "op6_mixing" and n >= 0


def test_many_rows_without_id(spark, monkeypatch):
    from quarrygraph.llm import fingerprints
    from pyspark.sql import Window

    monkeypatch.setattr(fingerprints, "NEIGHBOUR_ROWS", 8)
    rng = random.Random(2)
    texts = [prose(rng, 8) for _ in range(200)]
    d = docs(spark, texts, [None if k % 3 else k for k in range(200)])
    order = [r["text"] for r in d.select("text", "doc_id").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).collect()]
    want = sorted(v for v in edited_brute([(-k, t) for k, t in enumerate(order)]).values())
    got = fingerprints.edited_fingerprints(d)
    assert sorted((r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got.collect()) == want
    last, bucket, _ = fingerprints._id_buckets(d.select("doc_id"), "doc_id")
    sizes = [r["count"] for r in d.withColumn("_qg_k", last).groupBy(bucket.alias("b")).count().collect()]
    assert Window and max(sizes) < 60  # 133 rows have no id, and they don't stand in one bucket


def test_lines_without_ids_keep_one_copy(spark):
    rng = random.Random(3)
    own, shared = [prose(rng, 9) for _ in range(4)], prose(rng, 12)
    texts = [f"{o}\n{shared}" for o in own]
    out = [r["text"] for r in lines.dedup_lines(docs(spark, texts, [None] * 4)).collect()]
    assert sorted(shared in t for t in out) == [False, False, False, True] and all(any(o in t for t in out) for o in own)
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, texts, [None, 7, None, 5])).collect()}
    assert out[5] == texts[3] and out[7] == own[1] and out[None] in (own[0], own[2])


def test_repeated_rows_are_one_document(spark, tmp_path):
    rng = random.Random(4)
    shared, more = prose(rng, 12), prose(rng, 12)
    rows = [(1, f"{prose(rng, 9)}\n{shared}", "en", "s"), (2, f"{prose(rng, 9)}\n{shared}\n{more}", "en", "s"), (4, f"{prose(rng, 9)}\n{more}", "en", "s"), (3, more, "en", "s")]
    rows.append(rows[0])  # two documents have the shared line, three the other
    folder = tables(spark, tmp_path, rows)
    got = {r["doc_id"]: r["n_dropped"] for r in QUERIES["op7_line_dedup"](spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    rel = con.execute(ORACLE_SQL["op7_line_dedup"])
    at = [d[0] for d in rel.description]
    assert got == {1: 0, 2: 0, 3: 1, 4: 1} == {r[at.index("doc_id")]: r[at.index("n_dropped")] for r in rel.fetchall()}


# --- licences: every rule tried on every text, suppression pair by pair ---


def detections_brute(text, patterns):
    found = [(m.start(), m.end(), r) for r, p in patterns for m in p.finditer(text)]
    better = lambda a, b: (b[2].priority, b[0] - b[1], b[0], b[2].label) < (a[2].priority, a[0] - a[1], a[0], a[2].label)
    left = sorted(found, key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label))
    kept = []
    for d in left:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            assert all(not better(k, d) for k in kept)
            kept.append(d)
    return kept


def test_labels_and_scores_of_licences(spark):
    patterns = [(r, licenses.compiled(r)) for r in licenses.RULES]
    base = [(label, p) for label, _, p in licenses.Scanner().base]
    texts = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    some = {i: t for i, t in texts.items() if t and any(w in t.lower() for w in ("licen", "copyright", "gnu", "cc", "spdx", "reserved", "domain"))}
    some |= {i: t for i, t in texts.items() if len(some) < 400 and t is not None and len(t) < 3000}
    got = {r["doc_id"]: r for r in QUERIES["op2_licenses"](spark, DATA).collect()}
    seen = 0
    for i, t in list(some.items())[:600]:
        low = t.encode().lower()
        found = detections_brute(low, patterns)
        hits = {label for label, p in base if p.search(low)}
        assert got[i]["labels"] == ",".join(sorted(hits | {r.label for _, _, r in found}))
        assert got[i]["score"] == max([0.9] * bool(hits) + [r.confidence for _, _, r in found], default=0.0)
        assert sorted((d["start"], d["end"], d["label"]) for d in got[i]["detections"]) == sorted((a, b, r.label) for a, b, r in found)
        seen += bool(found)
    assert seen > 20 and bisect


# --- language: features and decoding by plain loops ---


def fold(b):
    return b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32


def language_brute(model, text):
    data = (text or "").encode()
    if not model.languages or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    x = [fold(b) for b in data]
    counts = np.zeros(language.DIMS)
    for k in range(len(x) - 2):
        if x[k] != 32 or x[k + 1] != 32:
            counts[(x[k] * 0x9E3779B1 + x[k + 1] * 0x85EBCA77 + x[k + 2] * 0xC2B2AE3D) % (1 << 32) >> 20] += 1
    f = np.sqrt(counts / max(counts.sum(), 1))
    margins = [float(f @ model.weights[:, b] + model.bias[b]) for b in range(model.code.shape[1])]
    loss = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margins, word, strict=True)) for word in model.code]
    share = [np.exp(min(loss) - v) for v in loss]
    best = int(np.argmin(loss))
    return model.languages[best], share[best] / sum(share)


def test_language_by_loops(spark):
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    d = table(spark, DATA, "documents")
    model = language.train(d.filter(~held_out))
    got = {r["doc_id"]: r for r in QUERIES["op3_language"](spark, DATA).collect()}
    for r in d.orderBy("doc_id").limit(60).collect():
        want, share = language_brute(model, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == want and abs(got[r["doc_id"]]["score"] - share) < 1e-3
    for t in ODD:
        want, share = language_brute(model, t)
        r = language.predict(docs(spark, [t]), model).first()
        assert r["lang_pred"] == want and abs(r["score"] - share) < 1e-3


def test_languages_share_the_sample(spark):
    d = docs(spark, ["t"] * 4000, lang=[f"l{k % 40}" for k in range(4000)])
    assert 200 < batches.sampled(d, "lang", "doc_id", 600, 400).count() < 700
    assert batches.sampled(d, "lang", "doc_id", 600, 40 * 600).count() == 4000


# --- quality: convolution, pooling and combination by plain loops ---


def quality_brute(net, data):
    """Mean and greatest responses of the chunks, and their logits' mean, greatest and least."""
    size, half = quality.CHUNK * quality.BLOCK, quality.CHUNK * quality.BLOCK // 2
    pairs = -(-(len(data) + quality.WIDTH) // half)
    buf = data + b"\0" * ((pairs + 2) * half - len(data) + quality.WIDTH)
    filters = net.filters.reshape(quality.WIDTH, quality.EMBED, quality.FILTERS)

    def response(start):
        return sum(net.embed[buf[start + k]] @ filters[k] for k in range(quality.WIDTH))

    chunks = []
    for c in range(max(1, pairs - 1)):
        begin, end = c * half, min(c * half + size, pairs * half)
        chunks.append(np.maximum(np.max([response(s) for s in range(begin, end, quality.STRIDE)], axis=0) + net.bias, 0))
    logits = [float(c @ net.head + net.head_bias) for c in chunks]
    # the last pair of blocks has no chunk of its own: the chunk before it covers it
    if pairs > 1:
        chunks.append(chunks[-1])
        logits.append(logits[-1])
    return np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), [np.mean(logits), max(logits), min(logits), np.log1p(len(data))]])


def test_quality_by_loops(spark):
    rng = random.Random(5)
    good, bad = [prose(rng, 60) for _ in range(40)], ["".join(rng.choice("xq#;0 ") for _ in range(300)) for _ in range(40)]
    d = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    net = model[0]
    texts = [prose(rng, n) for n in (1, 10, 25, 60)] + ["", "é" * 200, "x" * 127, "y" * 128]
    got = [r["score"] for r in quality.score(docs(spark, texts), model).orderBy("doc_id").collect()]
    for t, s in zip(texts, got, strict=True):
        z = float(quality_brute(net, t.encode()) @ net.combine[:-1] + net.combine[-1])
        assert abs(s - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 2e-3
    scored = [r["score"] for r in quality.score(d, model).orderBy("doc_id").collect()]
    assert min(scored[:40]) > max(scored[40:])


def test_all_chunks_cover_a_text():
    for n in (0, 1, 127, 128, 129, 256, 257, 1000):
        data = bytes(range(1, 251)) * 5
        chunks = quality.all_chunks(data[:n])
        got = chunks[0][: quality.CHUNK * quality.BLOCK] + b"".join(c[quality.CHUNK * quality.BLOCK // 2 : quality.CHUNK * quality.BLOCK] for c in chunks[1:])
        assert got.rstrip(b"\0") == data[:n] and {len(c) for c in chunks} == {quality.CHUNK * quality.BLOCK + quality.WIDTH}


# --- toxicity: a document's score from marginals over all paths ---


def test_toxicity_by_enumeration(spark):
    rng = random.Random(6)
    texts = [prose(rng, 30) + (" you vile scum " + prose(rng, 4) if i % 2 else "") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, texts), labels)
    field = model[0]
    new = ["vile scum", "good day", "you vile scum and more words", "one", "", "a vile day"]
    rows = toxicity.tag(docs(spark, new), model).orderBy("doc_id").collect()
    for t, r in zip(new, rows, strict=True):
        data = np.frombuffer(t.encode(), np.uint8)
        starts, ends, at, f = toxicity.word_features(data, np.array([0, len(data)]))
        e, n = field.emission(f), len(f)
        total, ones = 0.0, np.zeros(n)
        for m in range(2**n if n else 0):
            y = [m >> k & 1 for k in range(n)]
            w = np.exp(y[0] * field.start + sum(e[k] * y[k] for k in range(n)) + sum(field.step[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            ones += w * np.array(y)
        p = ones / total if n else ones
        z = float((toxicity.document_features(p, np.array([0, n])) @ field.combine[:-1] + field.combine[-1])[0])
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) < 1e-6
        words = [(int(a), int(b)) for a, b, q in zip(starts, ends, p, strict=True) if q >= toxicity.OFFENDING]
        assert all(any(s["start"] <= a and b <= s["end"] for s in r["spans"]) for a, b in words)
        assert sum(len(t.encode()[s["start"] : s["end"]].split()) for s in r["spans"]) == len(words)


def test_long_texts_teach_with_all_their_words(spark):
    """A term that stands behind 20,000 other words is learned."""
    rng = random.Random(7)
    pool = [prose(rng, 1) for _ in range(50)]
    texts = [" ".join(rng.choices(pool, k=3000)) + (" wicked" if i % 2 else "") + " end" for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, texts), labels)
    rows = toxicity.tag(docs(spark, ["a fine day", "a wicked day"]), model).orderBy("doc_id").collect()
    assert not rows[0]["spans"] and [rows[1]["spans"][0][k] for k in ("start", "end")] == [2, 8]


def test_held_out_columns(spark):
    for name, n, rest in (("op3_language", 4, 2), ("op9_quality", 5, 0), ("op10_toxicity", 5, 0)):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) for r in QUERIES[name](spark, DATA).select("doc_id", "held_out").collect())


def test_shorter_passages_are_reported(spark, tmp_path):
    """Passages of over 50 words under 400 bytes stay, but n_shared tells of them; other texts have none."""
    rng = random.Random(8)
    passages = [prose(rng, 200)[:300] for _ in range(10)]
    texts = [f"{prose(rng, 60)} {passages[k % 10]} {prose(rng, 60)}" for k in range(20)] + [prose(rng, 150) for _ in range(30)]
    got = {r["doc_id"]: r for r in QUERIES["op8_suffix_dedup"](spark, tables(spark, tmp_path, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert all(got[i]["n_removed"] == 0 and (got[i]["n_shared"] > 0) == (i < 20) for i in range(50))
    assert all(got[i]["kept_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
