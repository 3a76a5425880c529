"""Token alignment against a loop over all pairs of tokens, encoded whole."""

import hashlib
import os
import random

import numpy as np
import pytest

from quarrygraph.llm import alignment
from quarrygraph.llm.alignment import align, intervals, op11_alignment, overlaps, products

from .helpers import ODD, SCHEMA, docs, prose

TOKENIZERS = alignment.TOKENIZERS
TEXTS = [*ODD, "a ", " a", "  two  spaces ", "x\n y\t z", "a  b   c", "tab \t end", "new\n\nline \n", "<|endoftext|> <s> </s> <unk> <0x41>", "has ▁ in it", "it's we'll 1234 5,678.9",
         "\U0001f600 \U0001f468‍\U0001f469 café é", "a\x00b \x1c c\x85d", " x ​ y", "word " * 50, "日本語" * 200, "  ", " "]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=os.path.join(TOKENIZERS, "piece_bpe_32k.model"))


def byte_decoder():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(extra)}


def spans(lengths):
    ends = np.cumsum(lengths).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []


def brute(texts, libraries):
    a_lib, b_lib = libraries
    decoder, out, held = byte_decoder(), [], {}
    for t in texts:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        bytes_a = [bytes(decoder[c] for c in a_lib.id_to_token(i)) for i in a]
        pieces = [b_lib.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            out.append(None)
            continue
        sa, sb = spans([len(x) for x in bytes_a]), spans([len(x) for x in bytes_b])
        links = [(i, j) for i, (p, q) in enumerate(sa) for j, (r, s) in enumerate(sb) if p < s and r < q]
        shared = sorted({q for _, q in sa} & {s for _, s in sb})
        groups = [([i for i, (_, q) in enumerate(sa) if lo < q <= hi], [j for j, (_, s) in enumerate(sb) if lo < s <= hi]) for lo, hi in zip([0, *shared[:-1]], shared, strict=True)]
        for pair in {(a[i], b[j]) for i, j in links}:
            held[pair] = held.get(pair, 0) + 1
        out.append((a, b, links, groups))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for r in out:
        if r is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = r
        counts = [held[a[i], b[j]] for i, j in links]
        text = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(n == most[a[i]] for n, (i, _) in zip(counts, links, strict=True)), sum(counts), hashlib.sha256(text.encode()).hexdigest()))
    return rows, out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(spark, tmp_path, texts, ids=None):
    docs(spark, texts, ids).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = op11_alignment(spark, str(tmp_path))
    assert out.columns == COLUMNS
    return [tuple(r) for r in out.collect()]


@pytest.mark.parametrize(("part", "pieces", "broadcast"), [(1 << 19, 200_000, 300_000), (40, 10, 0)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, libraries, part, pieces, broadcast):
    rng = random.Random(11)
    texts = TEXTS + [prose(rng, rng.randint(1, 60)) for _ in range(30)] + ["".join(rng.choice(" \n\tabé1.　'▁z") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    ids = [None, 3, 3, *range(10, len(texts) + 7)]
    monkeypatch.setattr(alignment, "PART_CHARS", part)
    monkeypatch.setattr(alignment, "KEPT_PIECES", pieces)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    want, _ = brute(texts, libraries)
    assert sorted(map(str, run(spark, tmp_path, texts, ids))) == sorted(str((i, *w)) for i, w in zip(ids, want, strict=True))


def test_vocabulary_files_agree_on_every_character(libraries):
    tokens = alignment.Tokenizers(tuple(open(os.path.join(TOKENIZERS, n), "rb").read() for n in (alignment.BYTES_FILE, alignment.PIECES_FILE)))
    for lo in range(0, 0x110000, 1 << 14):
        texts = ["a{0}b 1{0}2 {0}\n{0}\n  {0}'s{0}!{0}?".format(chr(c)) for c in range(lo, lo + (1 << 14), 5) if not 0xD800 <= c < 0xE000]
        assert [e.ids for e in libraries[0].encode_batch(texts, add_special_tokens=False)] == [tokens.first.encode_ordinary(t) for t in texts]


def test_overlaps_and_products(spark, libraries):
    texts = TEXTS[:30]
    _, parsed = brute(texts, libraries)
    got = {}
    for r in overlaps(docs(spark, texts)).collect():
        assert r["first_byte"] < r["last_byte"]
        got.setdefault(r["doc_id"], []).append((r["a_index"], r["b_index"], r["a_token"], r["b_token"], r["group"]))
    wide = {}
    for r in overlaps(docs(spark, texts), expand=True).collect():
        wide.setdefault(r["doc_id"], []).append((r["a_index"], r["b_index"], r["group"]))
    for n, one in enumerate(parsed):
        if one is None:
            assert n not in got
            assert n not in wide
            continue
        a, b, links, groups = one
        of = {i: g for g, (x, _) in enumerate(groups) for i in x}
        assert got[n] == [(i, j, a[i], b[j], of[i]) for i, j in links]
        assert sorted(wide[n]) == sorted((i, j, g) for g, (x, y) in enumerate(groups) for i in x for j in y)


def test_intervals():
    ends, a, b, group = intervals(np.array([2, 5, 6, 9]), np.array([1, 5, 9]))
    assert ends.tolist() == [1, 2, 5, 6, 9]
    assert (a.tolist(), b.tolist(), group.tolist()) == ([0, 0, 1, 2, 3], [0, 1, 1, 2, 2], [0, 0, 0, 1, 1])
    assert [x.tolist() for x in products(a, b, group)] == [[0, 0, 1, 1, 2, 3], [0, 1, 0, 1, 2, 2]]


def test_a_long_text_is_aligned_in_parts(spark):
    rng = random.Random(5)
    text = prose(rng, 3000)
    rows = align(docs(spark, [text * 40, text + "x" * 60_000])).select("doc_id", "n_a", "n_links", "groups", "pairs", "times").collect()
    assert all(len(set(r["pairs"])) == len(r["pairs"]) and sum(r["times"]) == r["n_links"] for r in rows)
    assert all(r["groups"].count(",") + r["groups"].count("|") + r["groups"].count(";") + 1 > r["n_a"] for r in rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_alignment(spark, str(tmp_path))
    assert out.columns == COLUMNS
    assert out.collect() == []
