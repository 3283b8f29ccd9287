import heapq
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from affinis.llm import huffman, token_files
from helpers import ODD_TEXTS, empty, families, frame
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import Split, WhitespaceSplit

PATH = public_tokenizers.path("word_bpe_49k.json")


def tree_cost(weights):
    heap, total = list(weights), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    return total


def test_code_is_optimal_limited_and_complete():
    rng = np.random.default_rng(7)
    weights = rng.integers(1, 1000, 700)
    lengths = huffman.code_lengths(weights, 16)
    assert (lengths * weights).sum() == tree_cost(weights.tolist())
    steep = (1.7 ** np.arange(40)).astype(np.int64)
    lengths = huffman.code_lengths(steep, 7)
    assert lengths.max() == 7 and (2.0 ** -lengths.astype(float)).sum() == 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(20, dtype=int), 4)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 50_000])
def test_blocks_decode_to_what_was_coded(n):
    ids = (np.random.default_rng(n).pareto(1.0, n) * 3).astype(np.int64) % 5000
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=5000), 16))
    data, starts = huffman.encoded(ids, code)
    assert (huffman.decoded(data, starts, n, code) == ids).all()
    if n > 600:  # a block by itself, from its checkpoint
        assert (huffman.decoded(data, starts[1:2], 256, code) == ids[256:512]).all()


def test_words_have_the_ids_of_whole_texts():
    library, words = Tokenizer.from_file(PATH), token_files.WordIds(PATH, room=20)
    assert words.shortcut
    texts = [t or "" for t in ODD_TEXTS] + families(8, 10) + ["İ. Σας ΣΑΣ ς, 3.5 don't é \x1c.\x1d. áb. <|endoftext|>x ﬁ. K ẞ"]
    for _ in range(2):
        assert [np.frombuffer(g, f"<u{words.width}").tolist() for g in words.of(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip_in_id_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    texts = [*ODD_TEXTS, *families(9, 20)]
    token_files.write(frame(spark, texts, ("ids", "part", "start")), str(tmp_path / "files"), PATH, 2)
    got = {r["doc_id"]: r for r in token_files.read(spark, str(tmp_path / "files")).collect()}
    library, at = Tokenizer.from_file(PATH), 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids))
        assert zlib.crc32(bytes(got[i]["ids"])) == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)


def test_no_documents_and_rows_without_ids(spark, tmp_path):
    assert token_files.report(empty(spark), str(tmp_path / "none"), PATH, 2).count() == 0
    docs = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (1, None)], "doc_id long, text string")
    rows = sorted((r["start"], r["doc_id"]) for r in token_files.report(docs, str(tmp_path / "odd"), PATH, 2).collect())
    assert [d for _, d in rows] == [None, 1, 3, 3] and [s for s, _ in rows] == [0, 2, 3, 5]


def other_tokenizers(tmp_path):
    """A tokenizer that tells capitals apart, one with a token over a space, and a byte-level one whose tokens hold the space before a word."""
    vocabulary = {w: i for i, w in enumerate(["[UNK]", "hello", "Hello", "HELLO", "world", "new york", "new", "york", "thing", "."])}
    for name, splits in (("cased", True), ("spaced", False)):
        made = Tokenizer(WordLevel(vocabulary, unk_token="[UNK]"))
        if splits:
            made.pre_tokenizer = WhitespaceSplit()
        else:
            made.pre_tokenizer = Split("|", "removed")
        made.save(str(tmp_path / name))
        yield str(tmp_path / name)
    yield public_tokenizers.path("byte_bpe_50k.json")


def test_other_tokenizers_get_whole_texts(tmp_path):
    for path in other_tokenizers(tmp_path):
        words = token_files.WordIds(path)
        assert not words.wordwise
        texts = ["Hello world", "hello HELLO Hello", "new york", "new york|hello", " the thing.  A\nthing", "", "é Zürich"]
        whole = Tokenizer.from_file(path)
        assert words.of(texts) == [words.packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_files.WordIds(public_tokenizers.path("word_bpe_49k.json")).wordwise
