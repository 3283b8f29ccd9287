import random
import re

import numpy as np
from affinis.llm import jaccard
from affinis.llm.components import components
from helpers import ODD_TEXTS, empty, families, frame


def brute(texts):
    """(number of shingles, smallest index that links lead to) of each text."""
    sets = []
    for t in texts:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def got_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_components_are_those_of_all_pairs(spark):
    texts = [*families(10), *ODD_TEXTS, "A b É", "a B É", "a b é"]
    assert got_of(jaccard.near_duplicates(frame(spark, texts, ("set_id", "parity", "component_id")))) == brute(texts)


def test_linked_sets_share_a_signature():
    """Sets at the very edge of similarity, of every size, also where partitions are empty."""
    rng = np.random.default_rng(11)
    for n in [*range(1, 40), 60, 99, 250, 1000]:
        for _ in range(12):
            both = rng.integers(0, 1 << 63, 2 * n + 2).astype(np.uint64)
            least = -(-80 * 2 * n // 180)  # members in common of two sets of n
            a, b = np.unique(both[:n]), np.unique(np.concatenate([both[:least], both[n:2 * n - least]]))
            assert np.isin(jaccard.signatures(a), jaccard.signatures(b)).any()
            m = n * 100 // 80  # a set and one as much larger as can link
            assert np.isin(jaccard.signatures(np.unique(both[:n])), jaccard.signatures(np.unique(both[:m]))).any()


def test_parity_never_shows_more_than_there_is():
    rng = np.random.default_rng(12)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 90)).astype(np.uint64)]))
        if len(y):
            assert jaccard.apart_at_least(jaccard.parity(x), jaccard.parity(y)) <= len(np.setxor1d(x, y))


def test_large_group_of_near_copies_and_copies(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join([*base[:i % 60], f"x{i}", *base[i % 60 + 1:]]) for i in range(150)] + [" ".join(base)] * 100
    got = got_of(jaccard.near_duplicates(frame(spark, texts)))
    assert {c for _, c in got.values()} == {0}


def test_chain_links_through(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 8:i * 8 + 100]) for i in range(30)]
    assert got_of(jaccard.near_duplicates(frame(spark, texts))) == brute(texts)


def test_texts_without_an_id_link_to_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 8:i * 8 + 100]) for i in range(30)]
    rows = [(i if i % 2 == 0 else None, t) for i, t in enumerate(texts)] + [(None, texts[3])] * 20 + [(None, "alone " + "z " * 9), (None, "")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # every second link of the chain has no id
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(i, 0) for i in range(0, 30, 2)]
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None and r["n_shingles"] > 50) == [(96, 0)] * 35
    assert {r["component_id"] for r in got if r["doc_id"] is None and r["n_shingles"] < 50} == {None}


def test_ids_that_are_missing_or_repeat(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s"), (2, "q r s"), (None, "z")], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(-1, 2, 5), (5, 2, 5), (5, 1, 2), (2, 1, 2), (-1, 1, None)], key=str)
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_keep_first_keeps_one_of_each(spark):
    texts = [*families(14, 15), None, ""]
    docs = frame(spark, texts, ("component_id",))
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute(texts).values()})


def test_components_of_links(spark):
    rng = random.Random(15)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(1, 1), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
