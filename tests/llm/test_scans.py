"""Operators 2, 3, 9, 10: brute force where there is one, else held-out accuracy; and the pipeline."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import labelled, language, licenses, quality, toxicity
from quarrygraph.llm.common import table
from quarrygraph.llm.registry import QUERIES

from .helpers import DATA, ODD, docs, prose

BIG = os.environ.get("TEST_LLM_BIG_DIR", "/root/testdata/sf0.1")


def scan_brute(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    rng = random.Random(1)
    bits = ["Licensed under CC BY-NC 4.0.", "the MIT License", "mit, license", "GNU General Public License, version 3", "Apache License 2.0", "apachelicense", "cc-by", "ccby", "CC\nBY", "gnu général public license", "SPDX-License-Identifier: BSD-3-Clause"]
    texts = ODD + ["".join(x + rng.choice([" ", "\n", ". ", "é"]) for x in rng.choices(bits + [prose(rng, 4)], k=rng.randint(1, 9))) for _ in range(80)] + ["MIT License " * 3000]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == scan_brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_rules():
    assert len(licenses.RULES) >= 300 and len({(r.label, r.pattern) for r in licenses.RULES}) == len(licenses.RULES)
    s = licenses.Scanner()
    found = [r.label for _, _, r in s.detections(b"licensed under the apache license, version 2.0")]
    assert "apache-2.0" in found and "generic" not in found
    assert [r.label for _, _, r in s.detections(b"spdx-license-identifier: mit")] == ["mit"]
    assert s.detections(b"nothing here") == []


def test_whole_table_of_licenses(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in QUERIES["op2_licenses"](spark, DATA).collect()}
    assert got == {i: scan_brute(t) for i, t in texts.items()}


def test_codewords():
    for n in (2, 3, 4, 5, 8, 30):
        code = language.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert len(code) == n and apart >= max(1, code.shape[1] // 4)


def test_language(spark):
    docs_ = table(spark, DATA, "documents")
    rows = QUERIES["op3_language"](spark, DATA).join(docs_.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_language_of_odd_rows(spark):
    rng = random.Random(2)
    fr = ["le la les des une est " * 20 + prose(rng, 5) for _ in range(20)]
    en = ["the and of that with is " * 20 + prose(rng, 5) for _ in range(20)]
    model = language.train(docs(spark, fr + en + ["zz"], lang=["fr"] * 20 + ["en"] * 20 + [None]))
    got = {r["doc_id"]: r for r in language.predict(docs(spark, ODD + ["the and of", "les des une"]), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4 and got[10]["lang_pred"] != "und"
    assert (got[len(ODD)]["lang_pred"], got[len(ODD) + 1]["lang_pred"]) == ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language.train(docs(spark, ["a"], lang=[None]))
    assert language.predict(docs(spark, ["abc"]), none).first()["lang_pred"] == "und"
    one = language.train(docs(spark, ["abc def"], lang=["en"]))
    assert language.predict(docs(spark, ["abc"]), one).first()["lang_pred"] == "en"
    assert language.predict(docs(spark, []), model).count() == 0


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no driver tables")
@pytest.mark.parametrize("op, label, least", [("op9_quality", "quality", 0.97), ("op10_toxicity", "toxic", 0.95)])
def test_held_out(spark, op, label, least):
    rows = QUERIES[op](spark, BIG).join(table(spark, BIG, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    y, s = np.array([r[label] for r in held]), np.array([r["score"] for r in held])
    assert auc(s, y) > least
    assert np.mean((s >= (0.3 if label == "quality" else 0.5)) == y) > 0.95


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(1, 1, 0), (2, 0, 1)], [(1, 1, 0), (1, 0, 1), (2, None, None)]])
def test_few_labels(spark, rows):
    d = docs(spark, ODD)
    scores = [r["score"] for r in quality.score(d, quality.train(d, labels_of(spark, rows))).collect()]
    scores += [r["score"] for r in toxicity.tag(d, toxicity.train(d, labels_of(spark, rows))).collect()]
    assert len(scores) == 2 * len(ODD) and all(0 <= s <= 1 for s in scores)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(4), 0.0, rng.normal(size=(2, 2)), 0.3)
    e, at = rng.normal(size=9), np.array([0, 4, 4, 9])
    got = toxicity.marginals(field, e, at)
    for a, b in zip(at[:-1], at[1:], strict=True):
        n, total, ones = b - a, 0.0, np.zeros(b - a)
        for m in range(2**n if n else 0):
            y = [m >> k & 1 for k in range(n)]
            w = np.exp(y[0] * field.start + sum(e[a + k] * y[k] for k in range(n)) + sum(field.step[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            ones += w * np.array(y)
        if n:
            assert np.allclose(got[a:b], ones / total)


def test_pair_marginals():
    p11 = toxicity._pair(np.array([0.3]), np.array([np.log(0.4 / 0.6)]), 1.2, -0.5)[0]
    odds = p11 * (1 - 0.3 - 0.4 + p11) / ((0.3 - p11) * (0.4 - p11))
    assert np.isclose(np.log(odds), 1.7)


def test_toxic_spans(spark):
    rng = random.Random(6)
    texts = [prose(rng, 40) + (" you vile!scum " + prose(rng, 5) if i % 2 else "") for i in range(400)]
    d = docs(spark, texts)
    model = toxicity.train(d, labels_of(spark, [(i, 1, i % 2) for i in range(400)]))
    new = docs(spark, [prose(rng, 20), "Good day, VILE scum. " + prose(rng, 20), None, ""])
    got = [r for r in toxicity.tag(new, model).orderBy("doc_id").collect()]
    assert [r["score"] >= 0.5 for r in got] == [False, True, False, False]
    s = got[1]["spans"][0]
    assert "scum" in "Good day, VILE scum. "[s["start"] : s["end"]].lower()
    kept = toxicity.reject_toxic(new, model)
    assert kept.columns == new.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_one_label_rejects_nothing(spark):
    d = docs(spark, ["a b c", "d e f", None])
    for value in (0, 1):
        model = toxicity.train(d, labels_of(spark, [(i, 1, value) for i in range(40)]))
        assert sorted(r["doc_id"] for r in toxicity.reject_toxic(d, model).collect()) == [0, 1, 2]


def test_long_texts_teach_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 5000)
    texts = ["x" * (6000 if i % 10 == 0 else 2000 if i % 10 == 1 else 100) for i in range(600)]
    d = docs(spark, texts).unionByName(docs(spark, texts))
    rows, counts = labelled.training_rows(d, labels_of(spark, [(i, int(i % 3 > 0), 0) for i in range(600)]), "quality", 200)
    got = rows.collect()
    size = {y: [len(r["text"]) for r in got if r["label"] == y] for y in (0, 1)}
    assert sum(counts.values()) > 400
    assert all(3000 < sum(v) <= 5000 and 2000 in v and 6000 not in v for v in size.values())
    assert len({r["k"] for r in got}) == len(got)


def test_chunks_cover_the_document():
    net = quality.fit(np.zeros((0, 264), np.uint8), np.zeros(0))
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 120, 127, 128, 129, 300, 1000):
        data = rng.integers(1, 255, n).astype(np.uint8)
        whole = quality.document_features(net, data, np.array([0, n]))
        pair = quality.document_features(net, np.concatenate([data, data]), np.array([0, n, 2 * n]))
        assert np.allclose(whole[0], pair[0], atol=1e-4) and np.allclose(whole[0], pair[1], atol=1e-4)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs_ = table(spark, DATA, "documents")
    benchmark = table(spark, DATA, "benchmark")
    at, cols = docs_, docs_.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = at
        stage(spark, at, DATA).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert at.columns == cols and at.count() > 0
        if name == "toxicity":
            assert at.join(before, cols, "left_anti").count() == 0
        if name == "line_dedup":
            assert at.count() == before.count() and at.filter(F.char_length("text") != F.col("n_chars")).count() == 0
        if name == "near_dedup":
            from quarrygraph.llm.near_dups import near_groups

            assert at.count() == near_groups(before).select("component_id").distinct().count()
        if name == "decontamination":
            from quarrygraph.llm.decontamination import contamination

            assert contamination(at, benchmark).filter("size(spans) > 0").count() == 0
            assert before.count() - at.count() == contamination(before, benchmark).filter("size(spans) > 0").count()
    assert at.columns == [*cols, "copy_no"]


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    d = docs(spark, ODD + [None], [*range(len(ODD)), None])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, DATA)
        assert set(d.columns) <= set(out.columns)
        out.count()
        assert stage(spark, d.limit(0), DATA).count() == 0


def test_sample_is_bounded(spark):
    d = docs(spark, ["t"] * 3000)
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(3000)])
    rows, counts = labelled.training_rows(d, labels, "quality", 100)
    assert sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(3000)) and 120 < rows.count() < 280
