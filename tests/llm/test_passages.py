import hashlib
import random

import numpy as np
from affinis.llm import passages
from helpers import ODD_TEXTS, empty, frame


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(i, first.get(b[p:p + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def got_of(df):
    return sorted(tuple(r) for r in df.collect())


def woven(seed, n=100):
    """Texts made of pieces of a few passages, of lengths around the threshold."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cé") for _ in range(400)) for _ in range(3)]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(300)
            text += rng.choice(base)[at:at + rng.choice([30, 49, 50, 51, 60, 100])] + rng.choice(["", "x", "zz"]) * rng.randint(0, 3)
        out.append(text)
    return out


def test_removed_bytes_are_those_of_brute_force(spark, monkeypatch):
    texts = [*woven(16), *[t for t in ODD_TEXTS], "a" * 300, "a" * 49, "a" * 120]
    assert got_of(passages.report(frame(spark, texts, ("kept", "tag", "starts")))) == brute(list(enumerate(texts)))
    monkeypatch.setattr(passages, "SETTLED", 50)  # many slices in a task
    assert got_of(passages.report(frame(spark, texts))) == brute(list(enumerate(texts)))


def test_ids_that_are_missing_or_repeat(spark):
    passage = "the passage that is in all of these documents, and is long enough"
    docs = spark.createDataFrame([(None, passage), (4, passage), (4, "x" + passage), (2, passage + "y"), (4, passage)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in passages.report(docs).collect())
    n = len(passage)
    assert got == [(0, n, 0), (2, n + 1, 0), (4, n, n), (4, n, n), (4, n + 1, n)]
    assert passages.report(empty(spark)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(17)
    inner = rng.integers(97, 100, 90).astype(np.uint8)
    found = []
    for pad in (0, 7, 31):
        data = np.concatenate([rng.integers(97, 100, pad).astype(np.uint8), inner, rng.integers(97, 100, 20).astype(np.uint8)])
        start, size, kin, _ = passages.blocks(data, np.array([len(data)]))
        name = np.repeat(kin, size)
        at = np.repeat(start, size) + np.concatenate([np.arange(s) for s in size])
        assert (at == np.arange(len(data) - 49)).all()
        found.append(name[pad:pad + 41])
    assert (found[0] == found[1]).all() and (found[1] == found[2]).all()
