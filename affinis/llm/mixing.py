"""Mixing sources: token weights raked to target shares of source, language and topic, then documents sampled by them.

Documents are first added up to cells of (source, language, topic). Raking multiplies the weights of the cells until each of the three
margins has its target shares: a pass scales every margin in turn, by grouped sums (one row for each of its values) joined back. Two sets of numbers go
through the same passes: `weight`, which meets the target shares as they are, and `expected`, the tokens to be drawn, of which no cell
can give more than it has. A value whose documents do not suffice for its share of the budget gives all it has, and the others share the rest; a cell that
is cut at its tokens is made up for by the other cells of its margins. Passes end when every margin is met, or after PASSES, where the cells'
own limits or contradicting targets leave a gap. Cells are as few as the combinations that occur, however many documents there are; they
stay a table and are never collected.

Draws are calibrated: documents have a fixed place in their cell by a hash, and each cell is cut where the tokens before the cut come nearest to what is expected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from affinis.session import materialise, stored

MARGINS = ("source", "lang", "topic")
#: Passes of raking at most, and the relative gap of all margins, as each is come to in a pass, that ends them.
PASSES, GAP = 20, 0.002
#: Shares are the margins' own, flattened by this power; share of all tokens that is to be kept.
FLATTEN, BUDGET = 0.7, 0.6
#: Steps by which a scale is found: each narrows it to one of so many parts.
STEPS, PARTS = 3, 256
#: Places in a cell that a cut can be at.
BINS = 4096


def words_of(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))).cast("bigint")


def topic_of(text: Column, words: Column) -> Column:
    """A rough topic by form: licences, tables, short notes, long reads, prose."""
    return (F.when(words == 0, "none").when(F.contains(text, F.lit("Licensed under")), "licence").when(F.contains(text, F.lit(" | ")), "table")
            .when(words < 40, "note").when(words >= 1000, "long").otherwise("prose"))


def place_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 up to BINS that is fixed for an id; a row without one goes by its text."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.floor(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), own)), 1, 8), 16, 10).cast("bigint") * BINS / (1 << 32)).cast("int")


def about(seed: int) -> Column:
    """Struct (cell, tokens, place) of a document; null sources and languages are a value of their own. Words are counted once."""
    text, named = F.col("text"), [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MARGINS[:2]]
    return F.element_at(F.transform(F.array(words_of(text)), lambda n: F.struct(
        F.struct(*named, topic_of(text, n).alias("topic")).alias("cell"), n.alias("tokens"), place_of(F.col("doc_id"), text, seed).alias("place"))), 1)


def described(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, place) of every document."""
    return docs.select("doc_id", F.explode(F.array(about(seed))).alias("d")).select("doc_id", "d.cell.*", "d.tokens", "d.place")


def own_shares(cells: DataFrame, margin: str, flatten: float = FLATTEN) -> DataFrame:
    """(margin, share): the margin's shares of tokens to a power below 1, which lifts the small ones."""
    sizes = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).where("n > 0").withColumn("power", F.pow("n", F.lit(flatten)))
    total = sizes.agg(F.sum("power")).first()[0] or 1.0
    return sizes.select(margin, (F.col("power") / total).alias("share"))


def goals(cells: DataFrame, shares: dict[str, DataFrame], goal: float) -> DataFrame:
    """(margin, value, share, target): tokens to draw of each value of the margins, which are looked at together. In proportion to the shares where the
    value has so many, else all it has, `goal` tokens in each margin."""
    sizes = [cells.groupBy(m).agg(F.sum("tokens").alias("n")).join(of.select(m, "share"), m, "left").select(
        F.lit(m).alias("margin"), F.col(m).alias("value"), "n", F.coalesce("share", F.lit(0.0)).alias("share")) for m, of in shares.items()]
    rows = materialise(reduce(DataFrame.unionAll, sizes))
    # From no tokens up to the scale at which every value gives all it has. What is drawn grows with the scale; a step looks at PARTS scales at once, as rows.
    most = F.max(F.when(F.col("share") > 0, F.col("n") / F.col("share")))
    bounds = rows.groupBy("margin").agg(F.coalesce(most, F.lit(1.0)).alias("high")).withColumn("low", F.lit(0.0))
    for _ in range(STEPS):
        part = (F.col("high") - F.col("low")) / PARTS
        tried = rows.join(bounds, "margin").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(PARTS))))
        drawn = tried.groupBy("margin", "low", "high", "i").agg(F.sum(F.least(F.col("n"), F.col("share") * (F.col("low") + part * F.col("i")))).alias("n"))
        found = drawn.groupBy("margin", "low", "high").agg(F.coalesce(F.min(F.when(F.col("n") >= goal, F.col("i"))), F.lit(PARTS)).alias("at"))
        bounds = found.select("margin", (F.col("low") + part * (F.col("at") - 1)).alias("low"), (F.col("low") + part * F.col("at")).alias("high"))
    target = F.least(F.col("n").cast("double"), F.col("share") * F.col("high"))
    return materialise(rows.join(bounds, "margin").select("margin", "value", "share", target.alias("target")))


def goals_of(all_goals: DataFrame, margin: str) -> DataFrame:
    return all_goals.where(F.col("margin") == margin).select(F.col("value").alias(margin), "share", "target")


def reachable(cells: DataFrame, shares: DataFrame, margin: str, goal: float) -> DataFrame:
    """(margin, share, target) of one margin's values, as goals() has them."""
    return goals_of(goals(cells, {margin: shares}, goal), margin)


def raked(cells: DataFrame, shares: dict[str, DataFrame], budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """`cells` (source, lang, topic, tokens) with `weight`, whose sums by margin have the target shares, and `expected`, at most `tokens`, whose sums have what
    goals() leaves of the share `budget` of all tokens. A value without a target has none; cells without tokens have weight 0."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    rows = cells.withColumn("weight", F.col("tokens").cast("double")).withColumn("expected", budget * F.col("tokens"))
    wanted = goals(cells, shares, budget * total)
    last = float("inf")
    for number in range(passes):
        gap, names = 0.0, list(shares)
        rows = rows.withColumn("off", F.lit(0.0))
        for margin in names:
            full = F.col("expected") >= F.col("tokens")
            sums = rows.groupBy(margin).agg(F.sum("weight").alias("w"), F.sum("expected").alias("e"), F.sum(F.when(full, F.col("expected")).otherwise(0.0)).alias("f"))
            off = lambda got, want: F.when(want > 0, F.abs(got / want - 1)).otherwise(0.0)
            sums = sums.join(goals_of(wanted, margin), margin).withColumn("by", F.greatest(off(F.col("w"), F.col("share") * total), off(F.col("e"), F.col("target"))))
            weight = F.when(F.col("w") > 0, F.col("weight") * F.col("share") * total / F.col("w")).otherwise(0.0)
            # Where more is to be drawn, cells that give all they have cannot give more: the others alone are scaled.
            more = (F.col("target") > F.col("e")) & (F.col("e") > F.col("f"))
            scale = F.when(more, (F.col("target") - F.col("f")) / (F.col("e") - F.col("f"))).otherwise(F.col("target") / F.col("e"))
            expected = F.when(F.col("e") > 0, F.least(F.col("tokens").cast("double"), F.col("expected") * scale)).otherwise(0.0)
            rows = rows.join(sums, margin).select(*MARGINS, "tokens", weight.alias("weight"), expected.alias("expected"), F.greatest("off", "by").alias("off"))
            # A small table after every second margin and at the end of a pass: a plan that reads itself twice a step doubles with each, and the driver keeps what it plans.
            if names.index(margin) % 2 or margin == names[-1]:
                rows, seen = stored(rows, {"off": F.coalesce(F.max("off"), F.lit(0.0))})
                gap = max(gap, seen["off"])
        rows = rows.drop("off")
        if gap <= GAP or number > 2 and gap > 0.95 * last:  # met, or as near as the cells' limits let it come
            break
        last = gap
    return rows


def cuts(rows: DataFrame, by_cell: DataFrame) -> DataFrame:
    """`by_cell` with `cut`: documents of the cell in places before it are drawn. A cell has at most BINS sums of tokens by place."""
    sums = rows.groupBy(*MARGINS, "place").agg(F.sum("tokens").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*MARGINS).orderBy("place")))
    near = upto.join(by_cell.select(*MARGINS, "expected"), list(MARGINS)).groupBy(*MARGINS, "expected").agg(
        F.min(F.struct(F.abs(F.col("upto") - F.col("expected")).alias("off"), (F.col("place") + 1).alias("cut"))).alias("best"))
    # No document at all may be nearer than the first.
    cut = F.when(F.col("expected") <= F.col("best.off"), 0).otherwise(F.col("best.cut"))
    return by_cell.join(near.select(*MARGINS, cut.alias("cut")), list(MARGINS))


def rates(rows: DataFrame, shares: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, tokens, weight, expected, cut) of the cells of described() rows, which are read several times. Shares default to own_shares()."""
    cells = materialise(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    return materialise(cuts(rows, raked(cells, shares or {m: own_shares(cells, m) for m in MARGINS}, budget)))


def mixed(docs: DataFrame, seed: int = 7, budget: float = BUDGET) -> DataFrame:
    """One row for each row of `docs`: doc_id, source, lang, topic, tokens, weight (of the document's tokens), rate and kept.

    `rate` is the share of its cell's tokens that is drawn. Of a document without tokens weight and rate are 0 and it is not kept. Rows that repeat a doc_id
    stay or go together if of one cell; so do rows without an id that have one text. Other columns are not read; an empty table gives no rows.
    """
    rows = materialise(described(docs, seed))
    by_cell = rates(rows, budget=budget).withColumnRenamed("tokens", "cell_tokens")
    some = F.col("cell_tokens") > 0
    share = F.when(some, F.col("tokens") * F.col("weight") / F.col("cell_tokens")).otherwise(0.0)
    rate = F.when(some, F.col("expected") / F.col("cell_tokens")).otherwise(0.0)
    return rows.join(by_cell, list(MARGINS)).select(
        "doc_id", *MARGINS, "tokens", share.alias("weight"), rate.alias("rate"), ((F.col("place") < F.col("cut")) & (F.col("tokens") > 0)).alias("kept"))


def sampled(docs: DataFrame, seed: int = 7, budget: float = BUDGET) -> DataFrame:
    """The documents that mixed() keeps, all columns as they are, whatever their names. Rows are as for mixed(): those without words go, those that repeat an id
    stay or go together; an empty table stays empty."""
    by_cell = rates(materialise(described(docs, seed)), budget=budget).select(F.struct(*MARGINS).alias("cell"), "cut")
    # Only these columns meet in the join, so no name of `docs` can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.explode(F.array(about(seed))).alias("d"))
    drawn = packed.select("row", "d.cell", "d.tokens", "d.place").join(by_cell, "cell").where((F.col("place") < F.col("cut")) & (F.col("tokens") > 0))
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
