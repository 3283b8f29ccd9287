"""Token ids of texts in files: canonical Huffman codes, blocks with bit-offset checkpoints, in ascending id order.

A set of token files is a folder of two Parquet tables, so that Spark writes and commits them in any store and a lost executor
does no harm: `code` (one row: the code lengths) and `segments`. A segment row holds some 2^18 ids of whole documents: `part`
and `seq` give its place in the order, `before` the ids of its part before it, `docs` and `counts` its documents and how many
ids each has (packed little-endian), `starts` the checkpoints and `data` the coded bits.

Two passes: texts are range-partitioned by id, tokenised in order and stored as plain ids; their counts over the whole corpus
make the code; then the stored ids are coded where they lie. Nothing whole passes through one task or the driver.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from affinis.llm.batches import pieces, texts_of
from affinis.llm.huffman import LIMIT, Code, code_lengths, decoded, encoded
from affinis.session import materialise

#: Ids in a segment; a document is never split.
SEGMENT = 1 << 18
#: Signs that Python takes for white space and the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


#: Byte-level signs: bytes that are printed stand for themselves, the others for signs from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = dict(zip(_PLAIN, map(chr, _PLAIN))) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordIds(dict):
    """Ids of texts by a tokenizer, each word looked up or given to the library once where its tokens never cross white space and small ASCII letters stand for
    capitals; `wordwise` says whether it passes the probes of that. Otherwise whole texts are given to the library.

    Remembers the last `room` to twice as many words, in two generations. A word of small letters alone that is normalised
    already goes straight to the library's merges, past its normaliser and splitter, which would not change it; a full stop or
    comma behind such a word is a word of its own. `shortcut` says whether the tokenizer at `path` works so.
    """

    def __init__(self, path: str, room: int = 320_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4  # bytes of an id
        self.room, self.old = room, {}
        probes = ["thing", "thing.", "é", "zürich,", "日本", "thing", "Thing.", "Hello", "HELLO", "hello", "ÉCOLE"]
        self.shortcut = hasattr(self.model, "tokenize")
        self.shortcut = self.shortcut and all(self.fast(w) == self.whole(w) for w in probes)
        self.clear()
        self.wordwise = False
        texts = ["hello Hello HELLO", "the thing of the thing. Of it", "a  b\tc\nd", " thing", "thing ", "New York new york", "Zürich, é, 日本 École"]
        self.wordwise = all(self.by_word(t) == self.whole(t) for t in texts)
        self.clear()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        width = self.width
        return b"".join([i.to_bytes(width, "little") for i in ids])

    def fast(self, word: str) -> bytes:
        """Ids of a word by the merges alone where that is the same, else by the whole tokenizer."""
        if word[-1] in ".," and word[:-1].lower().isalpha():
            return self[word[:-1]] + self[word[-1]]
        low = word.lower()
        if not low.isalpha() or "\u03a3" in word or not (word.isascii() or unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low)):
            return self.whole(word)
        if low != word:
            return self[low]
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS)
        return self.packed([token.id for token in self.model.tokenize(signs)])

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.fast(word) if self.shortcut else self.whole(word)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def by_word(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, (text.lower() if text.isascii() else text).split()))

    def of(self, texts: list[str]) -> list[bytes]:
        return [self.by_word(t) if self.wordwise and not any(c in t for c in SEPARATORS) else self.whole(t) for t in texts]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for each worker."""
    return WordIds(path)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, seq, before, docs, counts, width, ids): segments of plain ids of `width` bytes in ascending id order, equal ids by the
    text's hash.

    Rows without an id come first. Each document ends with `end_id`; a null or empty text has no other.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        docs: list[int] = []
        size = 0
        words = word_ids(tokenizer)
        width, end = words.width, words.packed([end_id])

        def segment() -> pa.RecordBatch:
            counts = np.array([len(i) // width for i in ids], dtype="<u4")
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                pa.array([counts.tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([b"".join(ids)], pa.binary())], ["part", "seq", "before", "docs", "counts", "width", "ids"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                for doc, found in zip(piece["id"].to_pylist(), words.of(texts_of(piece, "text"))):
                    docs.append(doc)
                    ids.append(found + end)
                    size += len(found) // width + 1
                    if size >= SEGMENT:
                        yield segment()
                        seq, before, size = seq + 1, before + size, 0
                        ids, docs = [], []
        if docs:
            yield segment()

    return (rows.repartitionByRange(parts, "id", tie).sortWithinPartitions("id", tie)
            .mapInArrow(run, "part int, seq int, before long, docs array<long>, counts binary, width int, ids binary"))


def counted(segments: DataFrame) -> np.ndarray:
    """How often each id occurs in all segments: sums by task first, so as many rows as there are ids meet the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids, width in zip(batch["ids"].to_pylist(), batch["width"].to_pylist()):
                found = np.bincount(np.frombuffer(ids, dtype=f"<u{width}"), minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = segments.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Token files of `docs` at `path`. An empty table gives files without segments. Other columns are not read."""
    spark = docs.sparkSession
    plain = materialise(tokenised(docs, tokenizer, end_id, id_col, text_col))
    counts = counted(plain)
    limit = max(LIMIT, int(max(1, (counts > 0).sum()) - 1).bit_length())
    code = Code(code_lengths(counts, limit))
    lengths = code.lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, dtype=np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data, starts = encoded(np.frombuffer(row["ids"][0].as_buffer(), dtype=f"<u{row['width'][0].as_py()}"), code)
                yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([starts.astype("<u8").tobytes()], pa.binary()), pa.array([data], pa.binary())], ["part", "seq", "before", "docs", "counts", "starts", "data"])

    plain.mapInArrow(run, "part int, seq int, before long, docs array<long>, counts binary, starts binary, data binary").write.option("compression", "none").parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of token files: where a document's ids start among all, how many it has, the checksum of
    its ids, and the ids themselves, packed as little-endian unsigned 32-bit integers; null with ids=False, for who needs none of them."""
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])
    segments = spark.read.parquet(f"{path}/segments")
    # A row for each part, of which there are as many as there were partitions; its offset goes to every task.
    sizes = segments.groupBy("part").agg(F.max_by(F.struct("before", "counts"), "seq").alias("last"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = [int(np.frombuffer(c, dtype="<u4").sum(dtype=np.int64)) for c in batch["counts"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["part"], pa.array([b + s for b, s in zip(batch["before"].to_pylist(), size)], pa.int64())], ["part", "size"])

    last = sizes.select("part", "last.before", "last.counts").mapInArrow(lambda it: map(summed, it), "part int, size long")
    offsets = last.select("part", F.coalesce(F.sum("size").over(in_order), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, dtype=np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(counts)
                found = decoded(row["data"], np.frombuffer(row["starts"], dtype="<u8"), int(ends[-1]), code).astype("<u4").tobytes()
                own = [found[4 * (e - c):4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["docs"], pa.int64()), pa.array(row["offset"] + row["before"] + ends - counts), pa.array(counts),
                    pa.array(list(map(zlib.crc32, own)), pa.int64()), pa.array(own if ids else [None] * len(own), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return segments.join(F.broadcast(offsets), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def report(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Written to token files at `path` and read back: place, number and checksum of each document's ids."""
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path, ids=False).drop("ids")
