"""Byte-level BPE: pre-tokenisation by array scans, cached pair merging, ids back to bytes.

The pattern of the rank files ('s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+) is not
run. Code points become classes; each class is a transition function of a small automaton; functions compose associatively,
so a blocked scan over arrays gives the state at every code point, and a token starts where state and neighbouring classes say.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from affinis.llm.batches import map_rows, packed, texts_of

#: Bytes of text handled at once; a longer text is handled by itself.
CHARS = 1_000_000

#: Classes of code points.
OTHER, LETTER, NUMBER, WHITE, SPACE, QUOTE2, QUOTE3, EDGE = range(8)
#: States: no memory; in a run of other signs or after a space; two and one letters of a contraction to come.
PLAIN, RUN, TWO, ONE = range(4)
#: For each class the states after PLAIN, RUN, TWO, ONE. A quote begins a contraction only where no run or space goes before.
STEPS = {
    OTHER: (RUN, RUN, RUN, RUN), LETTER: (PLAIN, PLAIN, ONE, PLAIN), NUMBER: (PLAIN,) * 4, WHITE: (PLAIN,) * 4, SPACE: (RUN,) * 4,
    QUOTE2: (ONE, RUN, RUN, RUN), QUOTE3: (TWO, RUN, RUN, RUN), EDGE: (PLAIN,) * 4,
}


def coded(states) -> int:
    return sum(s << 2 * i for i, s in enumerate(states))


FUNCTION = np.array([coded(STEPS[c]) for c in range(8)], dtype=np.uint8)
_code = np.arange(256)
_after = np.stack([_code >> 2 * s & 3 for s in range(4)])  # state after s by function
#: COMPOSED[f * 256 + g]: first f, then g.
COMPOSED = sum(((_code[None, :] >> 2 * _after[s][:, None]) & 3) << 2 * s for s in range(4)).astype(np.uint8).ravel()


SIGNS, WHITES = np.isin(np.arange(8), [OTHER, QUOTE2, QUOTE3]), np.isin(np.arange(8), [WHITE, SPACE])


def starting(last: int, kind: int) -> int:
    """Whether a token starts between two classes, contractions aside: 0 no, 1 yes, 2 as the next class says."""
    if kind == EDGE or last == EDGE:
        return 1
    if WHITES[kind]:
        return 2 if WHITES[last] else 1
    return int(last != SPACE and not (SIGNS[last] and SIGNS[kind]) and last != kind)


#: By last class * 8 + class.
STARTS = np.array([starting(i >> 3, i & 7) for i in range(64)], dtype=np.uint8)


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point, as the engine behind the rank files has letters, numbers and white space.

    Its Unicode version differs from Python's, so the engine is asked once for each class: of a text of all code points, the
    tokens of a one-class pattern are the members.
    """
    import tiktoken

    table = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for low in range(0, 0x110000, 1 << 14):
            some = "".join(map(chr, range(low, low + (1 << 14)))) if not 0xD800 <= low < 0xE000 else ""
            members = bytes(engine.encode_ordinary(some)).decode()
            table[np.frombuffer(members.encode("utf-32-le"), dtype=np.uint32)] = kind
    table[ord(" ")] = SPACE
    return table


def scanned(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan: at each place the composition of all functions up to it."""
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = COMPOSED[int(out[i - 1]) << 8 | int(out[i])]
        return out
    width = 1 << max(3, (n.bit_length() + 1) // 2)
    blocks = -(-n // width)
    grid = np.zeros(blocks * width, dtype=np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    for j in range(1, width):
        np.take(COMPOSED, grid[j - 1].astype(np.uint16) << 8 | grid[j], out=grid[j])
    carried = scanned(grid[-1])[:-1]
    grid[:, 1:] = COMPOSED[carried.astype(np.uint16)[None, :] << 8 | grid[:, 1:]]
    return grid.T.ravel()[:n]


def starts_of(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places where a token starts in an array of code points; `edges` are places of separators between texts."""
    kind = class_table()[points]
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        ahead = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        kind[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE2
        longer = np.zeros(len(quotes), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            longer |= (one == ord(a)) & (two == ord(b))
        kind[quotes[longer]] = QUOTE3
    kind[edges] = EDGE
    state = scanned(FUNCTION[kind]) & 3  # from PLAIN
    pair = kind.copy()
    pair[1:] |= kind[:-1] << 3
    pair[:1] |= EDGE << 3
    start = STARTS[pair]
    # After white space, only the last sign of a run stands apart, and only if something follows.
    late = np.flatnonzero(start == 2)
    following = kind[np.minimum(late + 1, len(kind) - 1)]
    start[late] = ~WHITES[following] & (following != EDGE)
    if len(quotes):  # letters of a contraction do not start a token, the letter after one does
        inside = np.flatnonzero(state >= TWO) + 1
        inside = inside[inside < len(kind)]
        start[inside] = 0
        after = inside + 1
        after = after[after < len(kind)]
        start[after[(state[after - 2] == ONE) & (kind[after] == LETTER)]] = 1
    return np.flatnonzero(start)


class Merges(dict):
    """bytes of a slice -> its ids as little-endian 32-bit integers. Remembers the last `room` to twice as many slices of up to
    64 bytes, in two generations."""

    def __init__(self, ranks: dict[bytes, int], room: int = 250_000):
        super().__init__()
        self.ranks, self.room, self.old = ranks, room, {}

    def __missing__(self, piece: bytes) -> bytes:
        out = self.old.get(piece)
        if out is None:
            rank = self.ranks.get(piece)
            out = rank.to_bytes(4, "little") if rank is not None else b"".join(i.to_bytes(4, "little") for i in (self.short(piece) if len(piece) <= 64 else self.merged(piece)))
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def short(self, piece: bytes) -> list[int]:
        """As merged(), for few parts, where looking through all pairs is quicker than a heap."""
        get, none = self.ranks.get, 1 << 62
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def merged(self, piece: bytes) -> list[int]:
        """The pair of lowest rank first, leftmost among equals; a heap and linked neighbours, so long slices take n log n."""
        ranks, n = self.ranks, len(piece)
        ends, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if middle < 0 or middle >= n or ends[middle] != end:
                continue  # one of the two parts has changed since
            ends[middle], ends[i] = -1, end
            if end < n:
                prev[end] = i
                if (r := ranks.get(piece[i:ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (before := prev[i]) >= 0 and (r := ranks.get(piece[before:end])) is not None:
                heapq.heappush(heap, (r, before, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:ends[i]]])
            i = ends[i]
        return out


@functools.cache
def vocabulary(path: str) -> tuple[Merges, list[bytes], np.ndarray]:
    """Merges, bytes by id and their lengths from a rank file, once for each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return Merges(ranks), table, np.array([len(t) for t in table], dtype=np.uint32)


def encoded(texts: list[str], merges: Merges) -> list[bytes]:
    """Ids of each text, packed."""
    joined = "\0".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        return []
    edges = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = starts_of(points, edges)
    data = joined.encode()
    at = starts
    if len(data) != len(points):
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = (np.cumsum(width) - width)[starts]
    at = [*at.tolist(), len(data)]
    ids = list(map(merges.__getitem__, [data[i:j] for i, j in zip(at, at[1:])]))
    out, start = [], 0
    for stop in np.searchsorted(starts, edges).tolist():
        out.append(b"".join(ids[start:stop]))
        start = stop + 1
    return out


def offsets_of(ids: bytes, lengths: np.ndarray) -> bytes:
    """The byte at which each token starts."""
    sizes = lengths[np.frombuffer(ids, dtype="<u4")]
    return (np.cumsum(sizes, dtype=np.uint32) - sizes).astype("<u4").tobytes()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, offsets) for every row of `docs`: token ids by the ranks in the file at `path`, and the byte at which each
    token starts, both as packed little-endian unsigned 32-bit integers.

    The file must be at the same path on every worker. A null or empty text has no tokens. Ids of rows may be null or repeat:
    there is one row for each row given. Other columns are not read.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        merges, _, lengths = vocabulary(path)
        ids = encoded(texts_of(batch, "text"), merges)
        return pa.RecordBatch.from_arrays([batch[0], packed(ids), packed([offsets_of(i, lengths) for i in ids])], ["id", "ids", "offsets"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, f"id {kind}, ids binary, offsets binary", "text", CHARS).withColumnRenamed("id", id_col)


def decoded(ids: bytes, offsets: bytes | None, table: list[bytes], lengths: np.ndarray) -> bytes:
    """Bytes behind packed ids. Offsets, where given, must agree with the lengths of the tokens."""
    numbers = np.frombuffer(ids, dtype="<u4")
    if offsets is not None:
        starts = np.frombuffer(offsets, dtype="<u4")
        if len(starts) != len(numbers) or (starts[:1] != 0).any() or (starts[:-1] + lengths[numbers[:-1]] != starts[1:]).any():
            raise ValueError("offsets and ids do not belong together")
    return b"".join(map(table.__getitem__, numbers.tolist()))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """`rows` of encode() and a column `decoded` with the bytes behind their ids. Null ids give null."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, table, lengths = vocabulary(path)
        out = [i if i is None else decoded(i, o, table, lengths) for i, o in zip(batch["ids"].to_pylist(), batch["offsets"].to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, packed(out)], [*batch.schema.names, "decoded"])

    kept = rows.drop("decoded")
    return map_rows(kept, run, StructType([*kept.schema.fields, StructField("decoded", BinaryType())]), "ids", CHARS)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) without leaving the task in between: (id, ids, offsets, decoded)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        merges, table, lengths = vocabulary(path)
        ids = encoded(texts_of(batch, "text"), merges)
        offsets = [offsets_of(i, lengths) for i in ids]
        back = [decoded(i, o, table, lengths) for i, o in zip(ids, offsets)]
        return pa.RecordBatch.from_arrays([batch[0], packed(ids), packed(offsets), packed(back)], ["id", "ids", "offsets", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, f"id {kind}, ids binary, offsets binary, decoded binary", "text", CHARS).withColumnRenamed("id", id_col)


def report(docs: DataFrame, path: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to."""
    return round_trip(docs, path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
