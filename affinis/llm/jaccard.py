"""Exact similarity join of documents on their word shingles, by PartEnum signatures.

Sets are cut into size bands so that linked sets lie in the same or neighbouring bands. For each band the domain of shingles is
divided by hash into groups of two partitions. Two linked sets differ in so few shingles that some group holds at most one
difference; the subsets of one of its two partitions are enumerated, and one of them has the same content in both sets. The hash
of such a content is a signature, and all linked sets share one. An empty content says nothing: a set with too few groups free of
empty partitions adds the signatures of further divisions until one is good enough, so that nothing is lost (see signatures()).

Each set of a group is first compared with one hub, then, once components are known, only with sets of its groups that are still
in other components. So a group of copies costs one comparison for each member. Pairs first meet as small parity sketches, whose
difference is never more than that of the sets; only pairs that this does not rule out leave the task, to be compared exactly. Equal
sets count as one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from affinis.llm import bloom
from affinis.llm.batches import map_rows, packed, pieces, texts_of
from affinis.llm.components import components
from affinis.session import materialise

#: Words in a shingle; sets link from this many hundredths of Jaccard similarity.
WORDS, PERCENT = 5, 80
#: Signatures that one task sorts at a time, at most about.
BUCKET = 1_000_000
#: Sets of a list that meet in one task.
BLOCK = 2000
#: Divisions of the domain a set may add, after which empty contents count as well.
DIVISIONS = 64

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


_BASE = 0xD6E8FEB86659FD93
#: A number for each byte, the same for both cases of A-Z; spaces count nothing.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_LETTERS[65:91] = _LETTERS[97:123]
_LETTERS[_SPACE] = 0


@cache
def _powers(upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for texts of fewer than `upto` bytes."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(upto, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return tuple(out)


def words(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text, from sums over its bytes: no word is cut out."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    letters = _LETTERS.take(data)
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.not_equal(letters, 0, out=inside[1:])
    start = np.flatnonzero(inside[1:] > inside[:-1])
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    size = 1 << 16 if len(data) < 1 << 16 else 1 << len(data).bit_length()
    powers, inverse = _powers(size) if size <= 1 << 20 else _powers.__wrapped__(size)  # tables for very long texts are not kept
    letters *= powers[: len(data)]
    w = np.add.reduceat(letters, start) * inverse.take(start)  # up to the next word; spaces count nothing
    w ^= w >> np.uint64(32)
    w *= _ODD[3]
    return w ^ (w >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words of a text; of fewer words, one for all; of none, none."""
    w = words(text)
    if not len(w):
        return w
    n = min(len(w), WORDS)
    total = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total += w[j:len(w) - n + 1 + j] * _ODD[j]
    total = np.sort(mixed(total))
    new = np.ones(len(total), dtype=bool)
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set of hashes."""
    return int(mixed(np.array([mixed(s).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


@cache
def bands(upto: int = 1 << 40) -> list[int]:
    """First size of each band: from one to the next, sizes grow by no more than similarity allows."""
    out = [1]
    while out[-1] < upto:
        out.append(out[-1] * 100 // PERCENT + 1)
    return out


def differing(total: int) -> int:
    """Most differences of two linked sets whose sizes add up to `total`."""
    return total * (100 - PERCENT) // (100 + PERCENT)


@cache
def groups_of(band: int) -> tuple[int, int]:
    """(largest size, groups of two partitions) of a band; one group more in sixteen than differences demand, against empty ones."""
    largest = bands()[band + 1] - 1
    need = differing(2 * largest) // 2 + 1
    return largest, need + 1 + need // 16


def signatures(s: np.ndarray) -> np.ndarray:
    """Signatures of a set, for its band and the next.

    In a band a set of size n differs from a linked one of size m by at most d(n + m), m being at most n / 0.8 and the band's
    largest size; so at least `groups - d // 2` groups hold at most one difference, and one partition of each has the same content
    in both. If fewer groups than that have an empty partition here, some shared content is not empty. Otherwise the set adds a
    further division. Of two linked sets, the one that stops first has such a content in its last division, and the other, which
    goes at least as far, has the same.
    """
    out, n = [], len(s)
    own = int(np.searchsorted(bands(), n, side="right")) - 1
    for band in (own, own + 1):
        largest, groups = groups_of(band)
        if differing(2 * largest) == 0:  # only equal sets link
            out.append(mixed(np.array([np.uint64(set_id(s) & 0xFFFFFFFFFFFFFFFF) ^ np.uint64(band)], dtype=np.uint64)))
            continue
        good = groups - differing(n + min(largest, n * 100 // PERCENT)) // 2
        for division in range(DIVISIONS):
            salt = np.uint64((band << 8 | division) * int(_ODD[1]) & (1 << 64) - 1)
            spread = mixed(s + salt)
            part = ((spread >> np.uint64(32)) * np.uint64(2 * groups) >> np.uint64(32)).astype(np.int64)
            content = np.zeros(2 * groups, dtype=np.uint64)
            np.add.at(content, part, mixed(spread))
            some = np.bincount(part, minlength=2 * groups) > 0
            safe = int((~some.reshape(-1, 2).all(axis=1)).sum()) < good
            use = some if safe or division < DIVISIONS - 1 else np.ones_like(some)
            out.append(mixed(content + (np.arange(2 * groups, dtype=np.uint64) + np.uint64(1)) * _ODD[2] ^ salt)[use])
            if safe:
                break
    return np.concatenate(out)


def parity(s: np.ndarray) -> bytes:
    """A bit for each of about as many buckets as a set has members: whether it holds an odd number of them."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """Differences of two sets that their parities show. The buckets of a longer parity are added up to those of the shorter."""
    x, y = folded(x, len(y)), folded(y, len(x))
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, parity) of (doc_id, text); set_id and parity are null for the empty set."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([
            batch[0], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
            pa.array([parity(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "set_id", "parity"])

    return map_rows(docs, run, "doc_id long, n_shingles long, set_id long, parity binary", "text")


def sharing(docs: DataFrame, buckets: int) -> DataFrame:
    """(sets): distinct sorted lists of two or more set ids that share a signature.

    Signatures travel packed: a row for each slice of documents and bucket, 12 bytes for a signature and its set. Signatures of a
    bucket are told apart by 32 more bits, which leaves some lists of sets that share none: a small share at any size, as a bucket's
    signatures are bounded.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task are sent once
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = {i: s for t in texts_of(piece, "text") if len(s := shingles(t)) and (i := set_id(s)) not in seen}
                seen.update(sets)
                found = [signatures(s) for s in sets.values()]
                if not found:
                    continue
                owner = np.repeat(np.array(list(sets), dtype=np.int64), [len(f) for f in found])
                sig = np.concatenate(found)
                bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, owner, bucket = mixed(sig[order]), owner[order], bucket[order]
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                low = (sig & np.uint64(0xFFFFFFFF)).astype("<u4")
                cut = list(zip(at.tolist(), [*at[1:].tolist(), len(sig)]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), *[packed([x[i:j].tobytes() for i, j in cut]) for x in (low, owner)]], ["bucket", "low", "owner"])

    def met(table: pa.Table) -> pa.Table:
        sig, owner = (np.frombuffer(b"".join(table[c].to_pylist()), dtype=t) for c, t in (("low", "<u4"), ("owner", "<i8")))
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])  # copies have the same signatures
        sig, owner = sig[new], owner[new]
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(at, append=len(sig))
        names = np.add.reduceat(mixed(owner.view(np.uint64)), at) + size.astype(np.uint64)
        at, size, names = at[size > 1], size[size > 1], names[size > 1]
        names, first = np.unique(names, return_index=True)
        lists = [owner[i:i + n] for i, n in zip(at[first].tolist(), size[first].tolist())]
        return pa.table({"name": names.view(np.int64), "sets": pa.array(lists, pa.list_(pa.int64()))})

    rows = docs.mapInArrow(spread, "bucket int, low binary, owner binary")
    lists = rows.groupBy("bucket").applyInArrow(met, "name long, sets array<long>")
    return lists.groupBy("name").agg(F.first("sets").alias("sets")).select("sets")


def plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of set ids whose sizes and parities, in (set_id, n, parity), do not rule out a link."""
    one = marks.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x"))
    two = marks.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y"))
    sized = pairs.join(two, "b").join(one, "a").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = (n + m for n, m in zip(batch["n_a"].to_pylist(), batch["n_b"].to_pylist()))
        keep = [apart_at_least(x, y) <= differing(t) for x, y, t in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), total)]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(sized, run, "a long, b long")


def foreign(root: np.ndarray, n: np.ndarray, parities: np.ndarray, block: np.ndarray, nearest: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For members of a list, in two blocks or one, the places of those of another component that sizes and parities do not rule out;
    each pair once. With `nearest` at most one for each member."""
    roots, counts = np.unique(root, return_counts=True)
    most = roots[counts.argmax()]
    two = block.min() != block.max()
    for i in np.flatnonzero(root != most).tolist():
        other = (root != root[i]) & ((block != block[i]) if two else True)
        if not nearest:
            other[: i + 1] &= root[: i + 1] == most  # a pair outside the largest component is met twice
        at = np.flatnonzero(other & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])))
        distance = np.bitwise_count(parities[at] ^ parities[i]).sum(axis=1, dtype=np.int64)
        near = distance <= (n[at] + n[i]) * (100 - PERCENT) // (100 + PERCENT)
        at, distance = at[near], distance[near]
        if len(at):
            yield i, at[[distance.argmin()]] if nearest else at


def folded(parity: bytes, size: int) -> bytes:
    """A parity of `size` bytes at most from a longer one."""
    while len(parity) > size:
        half = len(parity) // 2
        parity = (int.from_bytes(parity[:half]) ^ int.from_bytes(parity[half:])).to_bytes(half)
    return parity


def apart(members: DataFrame, roots: DataFrame, marks: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of sets of one list (list, b) that lie in different components (node, root) and that sizes and parities do not rule
    out; with `nearest` at most one for each set and list.

    Lists within one component are left out. A list of more than BLOCK sets is cut into blocks, and every two of them meet in a task of
    their own.
    """
    here = members.join(roots.withColumnRenamed("node", "b"), "b", "left").select("list", "b", F.coalesce("root", "b").alias("root"))
    several = here.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    rows = here.join(several.select("list", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "list").join(marks.select(F.col("set_id").alias("b"), "n", "parity"), "b")
    own = F.pmod(F.xxhash64("b"), F.col("blocks"))
    rows = rows.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "b", "root", "n", "parity")

    def meet(table: pa.Table) -> pa.Table:
        found: list = []
        b, root, n, block = (table[c].to_numpy() for c in ("b", "root", "n", "block"))
        if table.num_rows > 1 and root.min() < root.max() and not (table["i"][0] != table["j"][0] and block.min() == block.max()):
            parities = table["parity"].to_pylist()
            size = min(map(len, parities))
            matrix = np.frombuffer(b"".join(folded(p, size) for p in parities), dtype=np.uint64).reshape(len(parities), -1)
            found = [(np.full(len(at), b[i]), b[at]) for i, at in foreign(root, n, matrix, block, nearest)]
        one, two = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(one, two), pa.int64()), "b": pa.array(np.maximum(one, two), pa.int64())})

    return rows.groupBy("list", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def hashed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (set_id, doc_id and others) with `content`, the packed hashes of the set, from the documents' texts in place of doc_id.

    A filter of the wanted documents goes before the join, so that texts of other documents are not shuffled.
    """
    wanted = materialise(wanted)
    sieve = bloom.build(wanted, "doc_id", wanted.count())
    sieve = bloom.Bloom(sieve.blocks, materialise(sieve.rows))
    texts = bloom.possible(docs, "doc_id", sieve, "maybe").where("maybe").select("doc_id", "text").join(wanted, "doc_id").drop("doc_id")
    kept = texts.drop("text").schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in texts_of(batch, "text")]
        same = [len(s) > 0 and set_id(s) == i for s, i in zip(sets, batch["set_id"].to_pylist())]  # an id may be that of several documents
        return pa.RecordBatch.from_arrays([*[batch[c] for c in kept.names], packed([s.tobytes() for s in sets])], [*kept.names, "content"]).filter(pa.array(same, pa.bool_()))

    return map_rows(texts, run, StructType([*kept.fields, StructField("content", BinaryType())]), "text")


def similar(x: bytes, y: bytes) -> bool:
    """Whether two sets of hashes, packed in order, link."""
    short, long = sorted((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)), key=len)
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= PERCENT * (len(short) + len(long) - both)


def linked(pairs: DataFrame, marks: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of set ids that link, compared exactly. `marks`: (set_id, n, parity, doc_id), one of the set's documents."""
    left = materialise(plausible(pairs, marks))
    names = marks.select("set_id", "doc_id")
    # A set is hashed once and goes to each set that it is compared with: few, as it shares signatures with them.
    moving = hashed(docs, left.groupBy(F.col("b").alias("set_id")).agg(F.collect_set("a").alias("others")).join(names, "set_id"))
    moving = moving.select(F.explode("others").alias("a"), F.col("set_id").alias("b"), F.col("content").alias("y"))
    fixed = hashed(docs, left.select(F.col("a").alias("set_id")).distinct().join(names, "set_id")).select(F.col("set_id").alias("a"), F.col("content").alias("x"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [similar(x.as_py(), y.as_py()) for x, y in zip(batch["x"], batch["y"])]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(moving.join(fixed, "a"), run, "a long, b long", "x")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of `docs`, ids being integers.

    Documents link when their sets of shingles have a Jaccard similarity of 0.8 or more; component_id is the smallest id that
    links lead to. A null, empty or blank text has no shingles and is its own component. Repeated ids are separate rows; of
    a row without an id the text can link, and its component has the smallest id there is, null if none. Empty tables give
    no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(sets_of(texts))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    lists = materialise(sharing(texts, max(partitions, int(total * 0.6) // BUCKET)).select(F.monotonically_increasing_id().alias("list"), "sets"))
    members = materialise(lists.select("list", F.explode("sets").alias("b")))
    named, sources = sets.where("doc_id is not null"), texts
    if not sets.where("doc_id is null and set_id is not null").isEmpty():
        # A text without an id goes by its hash, once however many copies it has; where two meet under one, hashed() tells their sets apart.
        unnamed = materialise(texts.where("doc_id is null").select(F.xxhash64("text").alias("doc_id"), "text").distinct())
        named, sources = named.unionByName(sets_of(unnamed)), texts.where("doc_id is not null").unionByName(unnamed)
    marks = materialise(members.select(F.col("b").alias("set_id")).distinct().join(
        named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity")), "set_id"))
    # First each set and one hub, the least of all sets that lead its lists.
    hubs = lists.select(F.element_at("sets", 1).alias("hub"), F.explode("sets").alias("b"))
    links = materialise(linked(hubs.groupBy("b").agg(F.min("hub").alias("a")).where("a <> b"), marks, sources))
    roots = materialise(components(links))
    # Then each set and the nearest of its lists that is still apart; then all that are still apart.
    for nearest in (True, False):
        links = materialise(links.union(linked(apart(members, roots, marks, nearest), marks, sources)))
        roots = materialise(components(links))
    placed = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, the one of the smallest doc_id, all columns as they are. Rows that repeat a
    doc_id stay or go together; rows without one stay. Ids are integers, as for near_duplicates(); null, empty and blank texts stay, an empty table stays empty."""
    gone = near_duplicates(docs).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
