"""Quality rules with thresholds that follow the data, by DataFrame functions alone.

Every text is measured once. Each measure goes to a quantile sketch of its language and source: counts of buckets that are exact up to 128
and some 1.6 % wide beyond, so sketches merge by adding counts, give the same quantiles in whatever order they merge, and stay
small whatever the number of documents. A language's sketch is the sum of those of its sources, the sketch of all that of the languages.
A threshold is a quartile moved out by a multiple of the distance between the quartiles. The few thresholds of each language and source
are then joined to the measured documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.session import materialise

#: Words in a window; fixed base rules: words at least, percent of repeated words at most.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Bits of a value that its bucket keeps.
BITS = 7
#: Thresholds lie this many quartile distances outside the quartiles. A sketch of fewer documents gives way to that of the language, then of all.
REACH, LEAST_DOCUMENTS = 3, 100
#: Measures in thousandths, with the least quartile distance that counts; word length also has a lower threshold.
MEASURES = {"symbols": 50, "dup_lines": 150, "repeats": 100, "word_length": 400}
TWO_SIDED = "word_length"

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, signs: str) -> Column:
    """Number of code points of `text` that are none of `signs`."""
    return F.length(F.translate(text, signs, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of `window` words that the text has twice or more; windows are compared as 64-bit hashes."""
    def covered(hashes: Column) -> Column:
        """Repeated windows in order of hash, then place; then their places in order, each covering up to the next."""
        def repeated(pairs: Column) -> Column:
            same = lambda i, j: F.coalesce(F.try_element_at(pairs, i)["h"] == F.try_element_at(pairs, j)["h"], F.lit(False))
            kept = F.filter(F.transform(pairs, lambda p, i: F.when(same(i + 1, i + 2) | ((i > 0) & same(i + 1, F.greatest(i, F.lit(1)))), p["at"])), lambda at: at.isNotNull())
            return let(F.array_sort(kept), lambda at: F.aggregate(
                F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window))), F.lit(0), lambda total, n: total + n))

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, repeated))

    hashed = lambda own: let(
        F.transform(own, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(own) - window + 1), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(window)])))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashed(words), covered))


def counts(text: Column) -> Column:
    """Struct (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of a whole text; all zero for null and empty ones."""
    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    text = F.coalesce(text, F.lit(""))
    words = let(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)), of_lines)
    chars = F.struct(without(text, SPACES).cast("long").alias("word_chars"), (F.length(text) - without(text, "#*$%&|<>")).cast("long").alias("n_symbols"))
    return F.struct(words.alias("w"), lines.alias("l"), chars.alias("c"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed) of every row, and a column for each
    of MEASURES. Null languages and sources count as empty names."""
    # Spark may copy a column into each place that uses it; what is stored is computed once.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
                       F.explode(F.array(counts(F.col(text_col)))).alias("n"))
    rows = rows.select("id", "lang", "source", "n.w.n_words", "n.c.word_chars", "n.c.n_symbols", "n.l.n_lines", "n.l.n_dup_lines", "n.w.n_repeat_words")
    share = lambda part, whole: F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(0).cast("long")
    return rows.select(
        "*", ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "n_words").alias("symbols"), share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"), share("word_chars", "n_words").alias("word_length"))


def bucket(value: Column) -> Column:
    """The least value of the bucket of a whole number: its first BITS binary digits, the others zero."""
    off = F.greatest(F.lit(0), F.length(F.bin(value)) - BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, off), off)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the quantile sketches of the rows that pass the base rules. Counts are added up in each task first."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    return (rows.where(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("m"))
            .groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n")))


def levels() -> Column:
    """The three sketches that a language and source belongs to, the narrowest first: its own, the language's, that of all."""
    at = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("of_lang"), source.alias("of_source"))
    lang, source, none = F.col("lang"), F.col("source"), F.lit("")
    return F.explode(F.array(at(0, lang, source), at(1, lang, none), at(2, none, none)))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, of_lang, of_source, documents, high_<measure>, low_word_length): sketches merged by level, and the thresholds that they give."""
    keys = ["level", "of_lang", "of_source"]
    merged = sketch.select(levels().alias("at"), "measure", "bucket", "n").select("at.*", "measure", "bucket", "n").groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket")).alias("upto")
    placed = merged.select(*keys, "measure", "bucket", upto, F.sum("n").over(group).alias("documents"))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("documents"), F.col("bucket")))
    found = placed.groupBy(*keys, "measure").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("documents").alias("documents"))
    least = F.element_at(F.create_map(*[F.lit(x) for pair in MEASURES.items() for x in pair]), F.col("measure"))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), least)
    found = found.select(*keys, "measure", "documents", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    one = lambda side, m: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}")
    return found.groupBy(*keys).agg(F.max("documents").alias("documents"), *[one("high", m) for m in MEASURES], one("low", TWO_SIDED))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, level, documents, high_<measure>, low_word_length) for every language and source among measured rows: of its own sketch where that
    holds LEAST_DOCUMENTS, else of the language's, else of all documents'."""
    sketch = materialise(sketches(rows))
    groups = sketch.select("lang", "source").distinct()
    each = groups.select("lang", "source", levels().alias("at")).select("lang", "source", "at.*").join(fences(sketch), ["level", "of_lang", "of_source"])
    best = F.struct("level", "documents", *[f"high_{m}" for m in MEASURES], f"low_{TWO_SIDED}")
    return (each.where((F.col("documents") >= LEAST_DOCUMENTS) | (F.col("level") == 2)).groupBy("lang", "source").agg(F.min_by(best, "level").alias("best"))
            .select("lang", "source", "best.*"))


def passes() -> Column:
    """Whether a measured row beside its thresholds is within all of them."""
    out = ~F.col("base_failed") & (F.col(TWO_SIDED) >= F.col(f"low_{TWO_SIDED}"))
    for m in MEASURES:
        out = out & (F.col(m) <= F.col(f"high_{m}"))
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of `docs`: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines.

    Null texts count as empty and fail the base rules, as all texts of fewer than 20 words do. Null languages and sources are a language and a
    source of their own. Ids may repeat or be null; other columns are not read. An empty table gives no rows.
    """
    rows = materialise(measured(docs, id_col, text_col, lang_col, source_col))
    # A language and source without a sketch has only rows that fail the base rules.
    both = rows.join(thresholds(rows), ["lang", "source"], "left")
    return both.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       F.coalesce(passes(), F.lit(False)).alias("kept"), "n_lines")


def _sql() -> str:
    least = " ".join(f"WHEN '{m}' THEN {n}" for m, n in MEASURES.items())
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM measured WHERE NOT base_failed" for m in MEASURES)
    wide = ", ".join(f"max(high) FILTER (measure = '{m}') AS high_{m}" for m in MEASURES)
    fence = f"""SELECT {{keys}} max(documents) AS documents, max(low) FILTER (measure = '{TWO_SIDED}') AS low, {wide} FROM (
      SELECT {{keys}} measure, documents, min(bucket) FILTER (4 * upto >= documents) AS q1, min(bucket) FILTER (4 * upto >= 3 * documents) AS q3,
        {REACH} * greatest(q3 - q1, CASE measure {least} END) AS reach, q1 - reach AS low, q3 + reach AS high
      FROM (SELECT {{keys}} measure, bucket, sum(n) OVER (PARTITION BY {{keys}} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {{keys}} measure) AS documents
            FROM (SELECT {{keys}} measure, bucket, sum(n) AS n FROM sketch GROUP BY {{keys}} measure, bucket))
      GROUP BY {{keys}} measure, documents) {{group}}"""
    best = "CASE WHEN a.documents >= {n} THEN a.{c} WHEN b.documents >= {n} THEN b.{c} ELSE c.{c} END"
    inside = " AND ".join(f"m.{m} <= {best.format(n=LEAST_DOCUMENTS, c='high_' + m)}" for m in MEASURES)
    return rf"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, part) AS times
  FROM (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS part FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM texts))),
repeated AS (
  SELECT doc_id, sum(covered)::BIGINT AS n FROM (SELECT doc_id, coalesce(least({WINDOW}, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i), {WINDOW}) AS covered FROM windows WHERE times > 1)
  GROUP BY doc_id),
measured AS MATERIALIZED (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
    coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbols, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_lines,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeats, coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS word_length
  FROM texts LEFT JOIN repeated r USING (doc_id)),
sketch AS MATERIALIZED (
  SELECT lang, source, measure, (v >> greatest(0, length(bin(v)) - {BITS})) << greatest(0, length(bin(v)) - {BITS}) AS bucket, count(*) AS n
  FROM ({each}) GROUP BY ALL),
a AS ({fence.format(keys="lang, source, ", group="GROUP BY lang, source")}),
b AS ({fence.format(keys="lang, ", group="GROUP BY lang")}),
c AS ({fence.format(keys="", group="")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
  coalesce(NOT base_failed AND m.{TWO_SIDED} >= {best.format(n=LEAST_DOCUMENTS, c="low")} AND {inside}, false) AS kept
FROM measured m LEFT JOIN a USING (lang, source) LEFT JOIN b USING (lang) CROSS JOIN c"""


#: The same for the table of documents in DuckDB.
SQL = _sql()
