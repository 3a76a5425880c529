"""The stages of the pipeline and the licence rules do the whole job."""

import random
import re

import corpus_pipeline
import numpy as np

from quarrygraph.llm import licenses, near_dups, toxicity

from .helpers import DATA, docs, prose


def deduped(spark, texts):
    return [r["text"] for r in corpus_pipeline.line_dedup(spark, docs(spark, texts), DATA).orderBy("doc_id").collect()]


def test_lines_of_two_documents(spark):
    rng = random.Random(1)
    a, b, own = prose(rng, 60), prose(rng, 6), [prose(rng, 12) for _ in range(3)]
    texts = [f"{own[0]}\n{a}\n{b}", f"{own[1]}\n  {a}\r\n{own[1]}", f"{b}\n{own[2]}\n\n"]
    assert deduped(spark, texts) == [texts[0], f"{own[1]}\n{own[1]}", f"{own[2]}\n\n"]
    w = a.split()
    edited = [a, " ".join([*w[:20], "edited", *w[21:]])]  # an open stretch needs three documents
    assert deduped(spark, edited) == edited


def test_short_and_unspaced_lines(spark):
    rng = random.Random(2)
    own = [prose(rng, 12) for _ in range(4)]
    wide = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(30))
    texts = [f"{own[k]}\nAll rights reserved.\nPosted by {name} on Monday\n---\n7." for k, name in enumerate(["Ann", "Bob", "Cy"])]
    assert deduped(spark, texts) == [texts[0], *[f"{own[k]}\n---\n7." for k in (1, 2)]]
    assert deduped(spark, [f"{wide}\n{own[0]}", f"{own[1]}\n{wide}"]) == [f"{wide}\n{own[0]}", own[1]]
    two = ["Thank you.\n" + own[0], "Thank you.\n" + own[1]]  # short lines need three documents
    assert deduped(spark, two) == two


def test_near_copies_by_jaccard(spark):
    rng = random.Random(3)
    texts, far = [], 0
    for k in range(30):
        w = prose(rng, 120).split()
        v = list(w)
        for i in rng.sample(range(4), 2 + k % 2):  # at most 15 of 116 shingles differ: 0.8 is about 12.9
            v[10 + 30 * i] = "edited"
        texts += [" ".join(w), " ".join(v)]
        far += (near_dups.simhash(texts[-1].encode()) ^ near_dups.simhash(texts[-2].encode())).bit_count() > 3
    assert far > 10
    sets = [set(near_dups.shingle_set(t.encode()).tolist()) for t in texts]
    alike = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert 0 < sum(alike) < 30
    d = docs(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_groups(d, radius=0, jaccard=0.8).collect()}
    assert got == {i: i - (i % 2) * alike[i // 2] for i in range(60)}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, DATA).collect()}
    assert not kept & {2 * k + 1 for k, ok in enumerate(alike) if ok} and {2 * k for k in range(30)} <= kept


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """Chains, tight groups and groups that bands join up but similarity doesn't, whatever the size of a block."""
    rng = random.Random(33)
    texts = []
    for _ in range(3):
        w = prose(rng, 150).split()
        for k in range(14):
            v = list(w)
            v[5 + 10 * k] = f"edit{k}"  # each is 5 of 146 shingles off the first
            texts.append(" ".join(v))
        chain = list(w)
        for k in range(10):  # neighbours are similar, the ends aren't
            chain[3 + 14 * k] = f"link{k}"
            texts.append(" ".join(chain))
    texts += [prose(rng, 60) for _ in range(10)]
    sets = [set(near_dups.shingle_set(t.encode()).tolist()) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    want[i] = want[j] = min(want[i], want[j])
    assert len(set(want)) == 13
    d = docs(spark, texts)
    for block in (512, 8, 3):
        monkeypatch.setattr(near_dups, "BLOCK_SETS", block)
        got = {r["doc_id"]: r["component_id"] for r in near_dups.near_groups(d, radius=0, jaccard=0.8).collect()}
        assert got == dict(enumerate(want)), block


def a_match(parsed, rng):
    """A random text that a parsed expression of the rules matches."""
    out = b""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += bytes([arg])
        elif op == "ANY":
            out += rng.choice([b"x", b"\n"])
        elif op == "IN":
            if str(arg[0][0]) == "NEGATE":
                out += rng.choice([b" ", b"\n", b"-", b"\r", b"*", b"\t", b"("])
            else:
                out += bytes([rng.choice([c for o, v in arg for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))])])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += b"".join(a_match(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
        elif op == "SUBPATTERN":
            out += a_match(arg[3], rng)
        elif op == "BRANCH":
            out += a_match(rng.choice(arg[1]), rng)
        else:
            assert op == "ASSERT_NOT"
    return out


def test_keywords_are_in_every_match():
    rng = random.Random(4)
    for rule in licenses.RULES:
        pattern = licenses.compiled(rule)
        for _ in range(20):
            text = a_match(re._parser.parse(pattern.pattern), rng)
            assert pattern.fullmatch(text) and rule.keyword in text, (rule, text)


def test_wrapped_licence_texts():
    rng = random.Random(5)
    scanner, ungated = licenses.Scanner(), licenses.Scanner()
    ungated.by_keyword = {b"": [x for v in ungated.by_keyword.values() for x in v]}

    def labels(text):
        return [r.label for _, _, r in scanner.detections(text)]

    assert labels(b"permission is hereby\ngranted, free of charge, to any person obtaining a copy") == ["mit"]
    assert labels(b"all rights\n * reserved") == ["all-rights-reserved"]
    assert labels(b"this software is provided 'as is', without any express or\nimplied warranty. in no event will the authors be held liable") == ["zlib"]
    assert "bsd-3-clause" in labels(b"neither the name of the\ncopyright holder nor the names of its contributors may be used to endorse")
    parsed = [re._parser.parse(licenses.compiled(r).pattern) for r in licenses.RULES]
    for _ in range(20):
        text = b" | ".join(a_match(rng.choice(parsed), rng) for _ in range(30))
        assert scanner.detections(text) == ungated.detections(text)


def test_words_by_all_bytes():
    rng = random.Random(6)
    words = ["a" * 18 + "b" + "c" * 5, "a" * 18 + "d" + "c" * 5, "Short", "short", "É" * 9, "é" * 9]
    texts = [f"{prose(rng, k)} {w}".encode() for k, w in enumerate(words)]
    _, _, at, f = toxicity.word_features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    last = f[at[1:] - 1, 0].tolist()
    assert last[0] != last[1] and last[2] == last[3] and last[4] == last[5] and len(set(last)) == 4


def test_terms_within_unspaced_text(spark):
    rng = random.Random(7)
    term = "毒語"

    def text(bad):
        c = [chr(0x4E00 + rng.randrange(400)) for _ in range(40)]
        k = rng.randint(6, 34)
        return "".join(c[:k]) + (term if bad else "") + "".join(c[k:])

    d = docs(spark, [text(i % 2) for i in range(400)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels)
    new = [text(i % 2) for i in range(40)]
    rows = toxicity.tag(docs(spark, new), model).orderBy("doc_id").collect()
    assert [r["score"] >= 0.5 for r in rows] == [bool(i % 2) for i in range(40)]
    for t, r in zip(new, rows, strict=True):
        at = t.encode().find(term.encode())
        assert at < 0 or any(s["start"] <= at and at + 6 <= s["end"] for s in r["spans"])
    data = np.frombuffer("日本語テキスト ab".encode(), np.uint8)
    starts, ends = toxicity.pieces(data, np.array([0, 22]), np.array([21, 24]))
    assert starts.tolist() == [0, 3, 6, 9, 12, 15, 22] and ends.tolist() == [6, 9, 12, 15, 18, 21, 24]
