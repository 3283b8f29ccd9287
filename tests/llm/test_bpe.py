import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from affinis.llm import bpe
from helpers import ODD_TEXTS, empty, frame

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def engine():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(PATH)[0].ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_ids_are_those_of_the_library(engine):
    rng = random.Random(1)
    signs = [*"abst'' '  \n\t\r.!12é²Ω\x85\xa0\x1c\u3000日𝒳lredvm\0", "'re", "'s", "'ll", " '", "''"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in ODD_TEXTS] + ["!" * 5000, " " * 999, "'" * 99, "<|endoftext|>"]
    assert [ids(g) for g in bpe.encoded(texts, bpe.vocabulary(PATH)[0])] == [engine.encode_ordinary(t) for t in texts]


def test_scan_composes_functions():
    rng = np.random.default_rng(2)
    functions = rng.integers(0, 256, 5000).astype(np.uint8)
    got, state = bpe.scanned(functions), [0, 1, 2, 3]
    for f, g in zip(functions.tolist(), got.tolist()):
        state = [f >> 2 * s & 3 for s in state]
        assert [g >> 2 * s & 3 for s in range(4)] == state


def test_both_merges_agree():
    merges = bpe.vocabulary(PATH)[0]
    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("theranouédst") for _ in range(rng.randint(1, 60))).encode()
        assert merges.short(piece) == merges.merged(piece)


def test_round_trip_and_digests(spark, engine):
    docs = frame(spark, ODD_TEXTS, ("ids", "offsets", "decoded", "n_tokens"))
    got = {r["doc_id"]: r for r in bpe.report(docs, PATH).collect()}
    assert len(got) == len(ODD_TEXTS)
    for i, t in enumerate(ODD_TEXTS):
        want = engine.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect():
        assert bytes(r["decoded"]).decode() == (ODD_TEXTS[r["doc_id"]] or "")
        starts = ids(r["offsets"])
        assert starts == sorted(starts) and len(starts) * 4 == len(r["ids"])
    assert bpe.report(empty(spark), PATH).count() == 0


def test_rows_without_an_id_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in bpe.report(docs, PATH).collect()) == [0, 1, 1]


def test_foreign_offsets_are_refused():
    _, table, lengths = bpe.vocabulary(PATH)
    one = bpe.encoded(["one two"], bpe.vocabulary(PATH)[0])[0]
    with pytest.raises(ValueError):
        bpe.decoded(one, np.arange(len(one) // 4, dtype="<u4")[::-1].tobytes(), table, lengths)
