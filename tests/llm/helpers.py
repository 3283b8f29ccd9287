"""What the tests of the training-data operators share."""

from __future__ import annotations

import random

#: Every table of texts is tried with these: null, empty, blank, repeated, very long, and signs outside ASCII.
ODD_TEXTS = [None, "", " \n\t ", "one", "one", "Ein Wort é 日本 𝒳 's", "x" * 30_000, "a b " * 8_000]


def frame(spark, texts, clash=()):
    """(doc_id, text) and, for each name in clash, a column of that name that no operator may trip over."""
    rows = [(i, t, *("extra" for _ in clash)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {c} string" for c in clash)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def families(seed, count=40, words=40):
    """Texts in families of near copies, of many sizes."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(count):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 7, 9, 12, 20, 60, 200, 500]))]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, len(text) // 50 + 1])):
                at = rng.randrange(len(text)) if text else 0
                kind = rng.random()
                if text and kind < 0.5:
                    text[at] = rng.choice(vocabulary)
                elif kind < 0.8 or not text:
                    text.insert(at, rng.choice(vocabulary))
                else:
                    del text[at]
            out.append(" ".join(text))
    rng.shuffle(out)
    return out
