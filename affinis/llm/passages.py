"""Repeated passages: every byte of a document that lies in a 50-byte string which also starts in a document with a smaller id.

Prefix doubling names all strings of a length at a position by the pair of names of its two parts, sorts the pairs, keeps what is not
unique and goes on to longer strings. To do so for every position of a corpus would move it many times over, so only sampled
positions are named at first: of the 24-byte strings in every 50 bytes, the one with the least hash (leftmost among equals) is the anchor.
Equal 50-byte strings have equal anchors. All windows of 50 bytes with the same anchor in a row are a block.

1. A block is named by the pair of its anchor's name and that of all bytes it reaches over. Of equal blocks only those of the smallest
   id stay open; all others are repeats as a whole. Blocks whose anchor is in one document alone are done as well.
2. Every window of the blocks still open is named by the pair of names of its 32 bytes at offset 0 and at offset 18, the offset grown
   past the threshold. Of equal pairs those of the smallest id are no repeats, all others are.

Names are 64-bit hashes of contents, so that ranks need no global count. Each sort deals packed arrays by name; equal names of
one slice of a task are settled before they are dealt, so a passage that very many documents share costs a row for each slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from affinis.llm import bloom
from affinis.llm.batches import map_rows, packed, pieces
from affinis.llm.jaccard import mixed
from affinis.session import materialise

#: Bytes of a string that counts as a repeat, of an anchor, and of the two parts of a window.
LENGTH, GRAM, PART = 50, 24, 32
#: Names that one task sorts at a time, about, and names settled together before they are dealt.
BUCKET, SETTLED = 1_000_000, 1_000_000
#: Buckets of names for each slice of documents, at most, when there are more than shuffle partitions.
SLICES = 8
#: Bytes of text handled at once.
CHARS = 500_000

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1
COLUMNS = {"name": "<u8", "kin": "<u4", "doc": "<i8", "tag": "<u4", "start": "<u4", "size": "<u2"}
STEPWISE = ("doc", "tag", "start")


def strings(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes from those of single bytes, by doubling."""
    n, out, done, length, power = len(h) - size + 1, None, 0, 1, _BASE
    while True:
        if size & length:  # the next `length` bytes of the string
            out = h[:n] if out is None else out * np.uint64(power) + h[done:done + n]
            done += length
        if length * 2 > size:
            return out
        h = h[: max(0, len(h) - length)] * np.uint64(power) + h[length:]
        length, power = length * 2, power * power & _M64


def least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size:]) if width > size else v


def blocks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, size, anchor name, block name) of the blocks of texts joined together; `ends` are where the texts end."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    letters = _BYTES[data]
    grams = mixed(strings(letters, GRAM))
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (least(order, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(len(anchor), dtype=bool)
    for end in ends[:-1].tolist():
        valid[max(0, end - LENGTH + 1):end] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]])) + 1
    at = anchor[start]
    powers = np.full(n + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(letters * powers[:n], dtype=np.uint64)])
    reach = (upto[stop + LENGTH - 1] - upto[start]) * inverse[start]
    name = mixed(mixed(grams[at]) + mixed(reach) + ((stop - start) * 64 + at - start).astype(np.uint64))
    return start, stop - start, mixed(grams[at]), name


def settled(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(open, repeats): of rows of equal name those of the smallest document, and all others."""
    order = np.lexsort((rows["doc"], rows["name"]))
    rows = {k: v[order] for k, v in rows.items()}
    first = np.ones(len(order), dtype=bool)
    first[1:] = rows["name"][1:] != rows["name"][:-1]
    least_doc = rows["doc"][np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else rows["doc"]
    repeat = rows["doc"] > least_doc
    return {k: v[~repeat] for k, v in rows.items()}, {k: v[repeat] for k, v in rows.items()}


def joined(runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows of a document that follow each other, as one run."""
    order = np.lexsort((runs["start"], runs["tag"], runs["doc"]))
    doc, tag, start, size = (runs[c][order] for c in ("doc", "tag", "start", "size"))
    end = start.astype(np.int64) + size
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != end[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(order)]])[: len(at)] - 1
    return {"doc": doc[at], "tag": tag[at], "start": start[at], "size": (end[last] - start[at]).astype("<u4")}


def dealt(rows: dict[str, np.ndarray], key: np.ndarray, buckets: int, kind: int) -> pa.RecordBatch:
    """Packed columns, a row for each bucket of `key`."""
    bucket = ((mixed(key) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((rows["start"], rows["tag"], rows["doc"], bucket))
    bucket = bucket[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    cut = list(zip(at.tolist(), [*at[1:].tolist(), len(bucket)]))
    sorted_rows = {c: rows[c][order].astype(t if kind == 0 or c != "size" else "<u4") if c in rows else None for c, t in COLUMNS.items()}
    for c in STEPWISE:  # differences, which are small and compress well
        steps = np.diff(sorted_rows[c], prepend=sorted_rows[c][:1])
        steps[at] = sorted_rows[c][at]
        sorted_rows[c] = steps
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), kind, dtype=np.int8)), *[packed([b"" if v is None else v[i:j].tobytes() for i, j in cut]) for v in sorted_rows.values()]],
        ["bucket", "kind", *COLUMNS])


DEALT = "bucket int, kind tinyint, " + ", ".join(f"{c} binary" for c in COLUMNS)
RUNS = "open boolean, doc long, tag long, starts binary, sizes binary"


SLICED = "open boolean, slice int, doc binary, tag binary, start binary, size binary"


def sliced(runs: dict[str, np.ndarray], open_: bool, slices: int) -> pa.Table:
    """A row for each slice of documents: the runs of all its documents, packed. A bucket knows a little of very many documents, so it gives no row for each."""
    runs = joined(runs)
    part = ((mixed(runs["doc"].view(np.uint64)) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")  # within a slice still by document, tag and start
    part = part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    cut = list(zip(at.tolist(), [*at[1:].tolist(), len(part)]))
    columns = {}
    for c, t in (("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("size", "<u4")):
        values = runs[c][order].astype(t)
        columns[c] = packed([(np.diff(values[i:j], prepend=values.dtype.type(0)) if c in STEPWISE else values[i:j]).tobytes() for i, j in cut])
    return pa.table({"open": pa.array(np.full(len(at), open_)), "slice": pa.array(part[at], pa.int32()), **columns})


def by_document(runs: dict[str, np.ndarray], open_: bool) -> pa.Table:
    """A row for each document: starts and sizes of its runs, packed."""
    runs = joined(runs)
    doc, tag, start, size = runs.values()
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    at = np.flatnonzero(new)
    cut = list(zip(at.tolist(), [*at[1:].tolist(), len(doc)]))
    return pa.table({
        "open": pa.array(np.full(len(at), open_)), "doc": pa.array(doc[at], pa.int64()), "tag": pa.array(tag[at].astype(np.int64)),
        "starts": packed([start[i:j].astype("<u4").tobytes() for i, j in cut]), "sizes": packed([size[i:j].astype("<u4").tobytes() for i, j in cut])})


def unpacked(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    part = table.filter(pc.equal(table["kind"], kind))
    out = {}
    for c, t in COLUMNS.items():
        t = t if kind == 0 or c != "size" else "<u4"
        runs = [np.frombuffer(x, dtype=t) for x in part[c].to_pylist()]
        out[c] = np.concatenate([np.cumsum(r, dtype=t) for r in runs] if c in STEPWISE else runs) if runs else np.zeros(0, dtype=t)
    return out


def gathered(table: pa.Table) -> pa.Table:
    """sliced() rows of one slice, from all buckets, by document."""
    out = []
    for open_ in (False, True):
        part = table.filter(pc.equal(table["open"], open_))
        runs = {}
        for c, t in (("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("size", "<u4")):
            found = [np.frombuffer(x, dtype=t) for x in part[c].to_pylist()]
            runs[c] = np.concatenate([np.cumsum(x, dtype=t) for x in found] if c in STEPWISE else found).astype(np.int64) if found else np.zeros(0, dtype=np.int64)
        out.append(by_document(runs, open_))
    return pa.concat_tables(out)


def sort_names(names: DataFrame, groups: bool, slices: int) -> DataFrame:
    """(open, doc, tag, starts, sizes) from dealt() rows, one row for each document and kind: runs of windows that are repeats and, with `groups`, the blocks of the smallest
    documents whose anchor is also that of another block and document. Kind 0 are names, kind 1 repeats found before."""
    def sort(table: pa.Table) -> pa.Table:
        left, repeats = settled(unpacked(table, 0))
        before = unpacked(table, 1)
        found = [sliced({c: np.concatenate([repeats[c].astype(np.int64), before[c].astype(np.int64)]) for c in ("doc", "tag", "start", "size")}, False, slices)]
        if groups:
            order = np.argsort(left["kin"], kind="stable")
            left = {c: v[order] for c, v in left.items()}
            if len(order):
                at = np.flatnonzero(np.concatenate([[True], left["kin"][1:] != left["kin"][:-1]]))
                number = np.repeat(np.arange(len(at)), np.diff(at, append=len(order)))
                several = (np.minimum.reduceat(left["name"], at) != np.maximum.reduceat(left["name"], at)) & (np.minimum.reduceat(left["doc"], at) != np.maximum.reduceat(left["doc"], at))
                found.append(sliced({c: v[several[number]].astype(np.int64) for c, v in left.items()}, True, slices))
        return pa.concat_tables(found)

    return names.groupBy("bucket").applyInArrow(sort, SLICED).groupBy("slice").applyInArrow(gathered, RUNS)


def settled_slices(found: Iterator[dict[str, np.ndarray]], buckets: int, key: str) -> Iterator[pa.RecordBatch]:
    """Names of a task, dealt by `key` in slices of about SETTLED, each settled by itself first."""
    held: list[dict[str, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([h[c] for h in held]) for c in COLUMNS}
        left, repeats = settled(rows)
        if len(repeats["doc"]):
            runs = joined(repeats)
            yield dealt(runs, runs["doc"].view(np.uint64) + runs["start"].astype(np.uint64), buckets, 1)
        if len(left["doc"]):
            yield dealt(left, left[key].astype(np.uint64), buckets, 0)

    for rows in found:
        held.append(rows)
        if sum(len(h["doc"]) for h in held) >= SETTLED:
            yield from flush()
            held = []
    if held:
        yield from flush()


def named_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """dealt() rows of the blocks of all documents (doc_id, text)."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for piece in pieces(batch, "text", CHARS):
                data = [t.encode() for t in piece["text"].to_pylist()]
                ends = np.cumsum([len(d) for d in data])
                start, size, kin, name = blocks(np.frombuffer(b"".join(data), dtype=np.uint8), ends)
                own = np.searchsorted(ends, start, side="right")
                tags = np.array([zlib.crc32(d) for d in data], dtype="<u4")
                yield {"name": name, "kin": (kin & np.uint64(0xFFFFFFFF)).astype("<u4"), "doc": piece["doc_id"].to_numpy()[own], "tag": tags[own],
                       "start": (start - np.concatenate([[0], ends])[own]).astype("<u4"), "size": size.astype("<u2")}

    return docs.mapInArrow(lambda batches: settled_slices(found(batches), buckets, "kin"), DEALT)


def named_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """dealt() rows of the windows in the open runs of documents (doc, tag, text, starts, sizes)."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for batch in batches:
            for piece in pieces(batch, "text", CHARS):
                for doc, tag, text, starts, sizes in zip(*(piece[c].to_pylist() for c in ("doc", "tag", "text", "starts", "sizes"))):
                    names = strings(_BYTES[np.frombuffer(text.encode(), dtype=np.uint8)], PART)
                    start, size = (np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in (starts, sizes))
                    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                    name = mixed(mixed(names[at]) + names[at + LENGTH - PART])
                    n = len(at)
                    yield {"name": name, "kin": np.zeros(n, dtype="<u4"), "doc": np.full(n, doc, dtype="<i8"), "tag": np.full(n, tag, dtype="<u4"), "start": at.astype("<u4"), "size": np.ones(n, dtype="<u2")}

    return rows.mapInArrow(lambda batches: settled_slices(found(batches), buckets, "name"), DEALT)


def of_documents(runs: DataFrame) -> DataFrame:
    """A row for each document with lists of packed starts and sizes, an entry from each of the sorts at most."""
    return runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("starts", "sizes")).alias("runs")).select("doc", "tag", F.col("runs.starts").alias("starts"), F.col("runs.sizes").alias("sizes"))


def sieve_of(rows: DataFrame) -> bloom.Bloom:
    sieve = bloom.build(rows, "doc", rows.count())
    return bloom.Bloom(sieve.blocks, materialise(sieve.rows))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, tag, starts, sizes): runs of windows that also start in a smaller document, for (doc_id, text) without nulls. tag is a
    checksum of the text, which tells rows of one id apart."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions, size // 18 // BUCKET)
    first = materialise(sort_names(named_blocks(docs, buckets), True, max(partitions, buckets // SLICES)))
    asked = materialise(of_documents(first.where("open")))
    windows = first.where("open").agg(F.sum(F.octet_length("starts"))).first()[0] or 0
    texts = bloom.possible(docs, "doc_id", sieve_of(asked), "maybe").where("maybe").select(F.col("doc_id").alias("doc"), "text")
    texts = texts.join(asked, "doc").where(F.crc32("text") == F.col("tag")).select("doc", "tag", "text", "starts", "sizes")
    buckets = max(partitions, windows * 5 // BUCKET)
    second = materialise(sort_names(named_windows(texts, buckets), False, max(partitions, buckets // SLICES)))
    return first.where("NOT open").union(second).select("doc", "tag", "starts", "sizes")


def kept(text: str, starts: list[bytes], sizes: list[bytes]) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, remaining bytes) of a text whose windows in the runs are repeats."""
    data = text.encode()
    start, size = (np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in (starts, sizes))
    change = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + size + LENGTH - 1, minlength=len(data) + 1)
    gone = np.cumsum(change)[:-1] > 0
    return int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row of `docs`; kept are the remaining bytes.

    A null text counts as empty. Rows of one id do not remove anything from each other; a row without an id loses nothing and
    removes nothing. Texts under 50 bytes stay whole. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = materialise(of_documents(repeats(rows.where("doc_id is not null"))))
    marked = bloom.possible(rows, "doc_id", sieve_of(found), "maybe")
    whole = marked.where(~F.col("maybe")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.encode("text", "utf-8").alias("kept"))
    cut = (marked.where("maybe").withColumn("tag", F.crc32("text")).join(found.withColumnRenamed("doc", "doc_id"), ["doc_id", "tag"], "left")
           .select("doc_id", "text", "starts", "sizes"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        done = [kept(t, s or [], z or []) for t, s, z in zip(texts, batch["starts"].to_pylist(), batch["sizes"].to_pylist())]
        return pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([d[0] for d in done], pa.int64()),
            pa.array([d[1] for d in done], pa.int64()), packed([d[2] for d in done])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return whole.union(map_rows(cut, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", "text")).withColumnRenamed("doc_id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """without_repeats() with the digest of the remaining bytes in their place."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
