"""Fingerprints of documents as invertible Bloom lookup sketches, by DataFrame functions alone.

A document is the set of digests of its paragraphs: its lines, cut every 256 code points. A sketch has cells in three rows; a digest
is added to one cell in each row: a count, the digests and their check values combined by exclusive or. Two sketches subtract cell by
cell, and what they share goes away. A cell that holds a single digest names it; taken out of its other cells, it uncovers more
(peeling), until both sides' differing digests are known or no such cell is left. Then larger sketches are tried: more buckets, each a
sketch of its own that takes the digests of its share of hash values, so the work stays in proportion to the text.

The fingerprint is the smallest sketch, of one bucket; its size does not depend on the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.session import materialise

#: Code points in a paragraph at most; rows and cells in a row of a sketch; digests of both sides that a bucket is meant for.
PIECE, ROWS, WIDTH, LOAD = 256, 3, 8, 8
#: Peeling steps: a bucket has hardly more digests than this.
STEPS = 12
#: How many times more buckets each further try has. After the last, the sets of digests themselves are compared.
TRIES = (1, 4, 16)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text; none for null and empty texts."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PIECE}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def check_of(k: Column) -> Column:
    return F.hash(k, F.lit("check"))


def places(h: Column) -> list[Column]:
    """The cells of the digest behind hash h, one in each row, from three bits of h each."""
    return [(F.shiftright(h, 3 * row).bitwiseAND(F.lit(WIDTH - 1)) + WIDTH * row).cast("int").alias(f"p{row}") for row in range(ROWS)]


def add(cell: Column, c: Column, item: Column) -> Column:
    return F.struct((cell["c"] + c).alias("c"), cell["k"].bitwiseXOR(item["k"]).alias("k"), cell["x"].bitwiseXOR(item["x"]).alias("x"))


def empty() -> Column:
    return F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).alias("x"))


def items(keys: Column, buckets: Column, salt: Column) -> Column:
    """Digests with bucket, check value and cells."""
    return F.transform(keys, lambda k: let(F.xxhash64(k, salt), lambda h: F.struct(
        F.pmod(F.shiftright(h, 16), buckets).alias("bucket"), k.alias("k"), check_of(k).alias("x"), *places(h))))


def cells(held: Column) -> Column:
    """The sketch of items: every cell with the items that belong to it."""
    def row(r: int) -> Column:
        return F.transform(F.sequence(F.lit(WIDTH * r), F.lit(WIDTH * r + WIDTH - 1)), lambda i: F.aggregate(
            held, empty(), lambda cell, item: F.when(item[f"p{r}"] == i, add(cell, F.lit(1), item)).otherwise(cell)))

    return F.concat(*[row(r) for r in range(ROWS)])


def sketch(keys: Column) -> Column:
    """The fingerprint: a sketch of one bucket."""
    return cells(items(keys, F.lit(1).cast("bigint"), F.lit(0)))


def bucketed(keys: Column, buckets: Column, salt: Column) -> Column:
    """Items of each bucket, in order of the buckets. Sorted among marks, one for each bucket, so that time is in proportion."""
    def cut(both: Column) -> Column:
        marks = F.array_compact(F.transform(both, lambda item, i: F.when(item["k"].isNull(), i)))
        return let(marks, lambda at: F.transform(at, lambda p, j: F.slice(both, p + 2, F.coalesce(F.try_element_at(at, j + 2), F.size(both)) - p - 1)))

    marks = F.transform(F.sequence(F.lit(0).cast("bigint"), buckets - 1), lambda b: F.struct(
        b.alias("bucket"), F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("int").alias("x"), *[F.lit(None).cast("int").alias(f"p{r}") for r in range(ROWS)]))
    return let(F.sort_array(F.concat(items(keys, buckets, salt), marks)), cut)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct((p["c"] - q["c"]).alias("c"), p["k"].bitwiseXOR(q["k"]).alias("k"), p["x"].bitwiseXOR(q["x"]).alias("x")))


def peeled(difference: Column, salt: Column) -> Column:
    """Struct (mine, theirs) of the digests on one side only, from subtracted sketches; null when peeling gets stuck."""
    def step(state: Column) -> Column:
        single = F.filter(state["cells"], lambda cell: (F.abs(cell["c"]) == 1) & (cell["x"] == check_of(cell["k"])))
        known = F.transform(F.array_distinct(single), lambda cell: let(F.xxhash64(cell["k"], salt), lambda h: F.struct(cell["c"], cell["k"], cell["x"], *places(h))))

        def take(found: Column) -> Column:
            left = F.transform(state["cells"], lambda cell, i: F.aggregate(found, cell, lambda now, item: F.when((item["p0"] == i) | (item["p1"] == i) | (item["p2"] == i), add(now, -item["c"], item)).otherwise(now)))
            side = lambda sign: F.transform(F.filter(found, lambda item: item["c"] == sign), lambda item: item["k"])
            return F.struct(left.alias("cells"), F.concat(state["mine"], side(1)).alias("mine"), F.concat(state["theirs"], side(-1)).alias("theirs"), (F.size(found) == 0).alias("over"))

        return let(known, take)

    none = F.array().cast("array<bigint>")
    start = F.struct(difference.alias("cells"), none.alias("mine"), none.alias("theirs"), F.lit(False).alias("over"))
    clear = lambda state: ~F.exists(state["cells"], lambda cell: (cell["c"] != 0) | (cell["k"] != 0) | (cell["x"] != 0))
    # A step that finds no single digest is the last one.
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: F.when(s["over"], s).otherwise(step(s)), lambda s: F.when(clear(s), F.struct(s["mine"], s["theirs"])))


def attempt(a: Column, b: Column, times: int) -> Column:
    """Number of differing digests by sketches with `times` as many buckets as both sets call for; null if a bucket gets stuck."""
    buckets = F.greatest(F.lit(1), times * F.ceil((F.size(a) + F.size(b)) / LOAD)).cast("bigint")
    salt = F.lit(times)

    def count(p: Column, q: Column) -> Column:
        # size() of nothing is -1 or null by a setting; a bucket that gets stuck must make the sum null
        return let(peeled(subtract(cells(p), cells(q)), salt), lambda d: F.when(d.isNotNull(), F.size(d["mine"]) + F.size(d["theirs"])))

    return let(buckets, lambda n: F.aggregate(
        F.zip_with(bucketed(a, n, salt), bucketed(b, n, salt), lambda p, q: F.when(F.size(p) + F.size(q) == 0, 0).otherwise(count(p, q))),
        F.lit(0), lambda total, n: total + n))


def differing(a: Column, b: Column, mine: Column, theirs: Column) -> Column:
    """Number of digests in one of two sets only, from the sketches `mine` and `theirs`, then from larger ones."""
    small = let(peeled(subtract(mine, theirs), F.lit(0)), lambda d: F.when(d.isNotNull(), F.size(d["mine"]) + F.size(d["theirs"])))
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return F.coalesce(small, *[attempt(a, b, times) for times in TRIES], exact)


def likeness(a: Column, b: Column, difference: Column) -> Column:
    """Jaccard similarity of two sets from their sizes and the size of their difference; 1 for two empty sets."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - difference) / (total + difference).cast("double"))


def written(sketch: Column) -> Column:
    """A sketch as text: count, digests, check values of each cell."""
    return F.array_join(F.transform(sketch, lambda cell: F.concat_ws(".", cell["c"], F.hex(cell["k"]), F.hex(cell["x"]))), "-")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, keys, cells, next_text, next_keys, next_cells): each document beside the next by descending id, the first after the last.

    Ids are cut into ranges at quantiles, so no task holds the whole order; each range gets the first document of the next range
    as a guard behind its last. Equal ids are ordered by a hash of the text; rows without an id come last.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.select(F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts)).first()[0] or []))
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col("id"))) if cuts else F.lit(0)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("range", F.when(F.col("id").isNull(), -1).otherwise(above))
    # One row for each range: its first document, and that of the range below.
    key = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "tie")
    heads = materialise(rows.groupBy("range").agg(F.max(key).alias("head")))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    after = F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    wanted = heads.select("range", after.alias("next")).select(F.col("range").alias("guarded"), F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie"))
    guards = (rows.join(F.broadcast(wanted), (F.coalesce("id", F.lit(-(1 << 63))) == F.col("next_id")) & (F.col("tie") == F.col("next_tie")))
              .select("id", "text", "tie", F.col("guarded").alias("range"), F.lit(True).alias("guard")).dropDuplicates(["range"]))
    both = rows.withColumn("guard", F.lit(False)).unionByName(guards).repartition("range")
    both = both.withColumn("keys", digests(F.col("text"))).withColumn("cells", sketch(F.col("keys")))
    within = Window.partitionBy("range").orderBy("guard", F.col("id").desc_nulls_last(), F.col("tie").desc())
    following = [F.lead(c).over(within).alias(f"next_{c}") for c in ("text", "keys", "cells")]
    return both.select("id", "text", "keys", "cells", "guard", *following).where(~F.col("guard")).drop("guard")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last half (rounded down) of the code points replaced by the first as many of the next document by
    descending id. near_edited and near_next are the likeness of the sketch to that of the edited text and of the next document. Null
    texts count as empty; equal texts have equal fingerprints. Ids may repeat; other columns are not read. An empty table gives no rows; a
    single document is its own next.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = (with_next(docs, id_col, text_col).withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text")
            .withColumn("edited_keys", digests(F.col("edited"))).withColumn("edited_cells", sketch(F.col("edited_keys"))))
    keys, cell = F.col("keys"), F.col("cells")
    for name in ("edited", "next"):
        other, theirs = F.col(f"{name}_keys"), F.col(f"{name}_cells")
        rows = rows.withColumn(f"off_{name}", differing(keys, other, cell, theirs)).withColumn(f"near_{name}", likeness(keys, other, F.col(f"off_{name}")))
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited", written(cell).alias("fingerprint"), written(F.col("edited_cells")).alias("edited_fingerprint"), "near_edited", "near_next")


def report(docs: DataFrame) -> DataFrame:
    """versions() with the digest of the edited text in its place."""
    rows = versions(docs)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
