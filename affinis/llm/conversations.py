"""Repair of the turn structure of conversations at least cost, by a run-length min-plus dynamic programme.

A conversation should read system? (user assistant)+. Each row is one symbol: the initial of its role and its fault. What a symbol does to the
costs of the four states (nothing yet, after system, after user, after assistant) is a 4 x 4 min-plus matrix. Equal consecutive
symbols are one run, and a run of length n is advanced through the binary powers of its matrix, which are cached. The choices are
then unrolled row by row from the costs that remain.

Products of such matrices can be taken in any grouping. So the rows of all conversations are sorted once by range and cut into chunks of bounded
size, wherever a conversation ends: chunks give the matrices of the conversations that they cut, the costs behind each cut follow from those few
matrices, and every chunk is unrolled on its own, a cut conversation from each of the four states it may start in. No task holds
a conversation's rows, however long it is. Identical rows of a turn are one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from affinis.session import materialise

#: Rows (identical ones counted once) in a chunk, about.
CHUNK = 50_000
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. The role that a user or assistant row takes on next leads here.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
ENDS = (0, 3)
#: Symbols: 0 is a row that must go; else 1 + twice the place of the initial among these (the last stands for all others), plus 1 if truncated.
INITIALS = "sua "

Vector = tuple[int, int, int, int]


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after it) of every edit that uses up a row, letters in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol:
        kind, late = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        if kind == 0 and state == 0 or kind == 1 and state != 2 or kind == 2 and state == 2:
            out.append(("K", late, kind + 1))
        out.append(("R", REROLE + late, NEXT[state]))
    return out


def closed(after: list[int]) -> Vector:
    """Costs when rows may be inserted first. Two inserts reach every state that more of them reach."""
    for _ in range(2):
        after = [min(c, INSERT + after[NEXT[q]]) for q, c in enumerate(after)]
    return tuple(after)


END: Vector = closed([0 if q in ENDS else 1 << 40 for q in range(4)])


@lru_cache(maxsize=1 << 10)
def power(symbol: int, exponent: int) -> tuple[Vector, ...]:
    """The min-plus matrix of 2 ** exponent rows of a symbol: [state before][state after] is the least cost, inserts before each row included."""
    if exponent:
        half = power(symbol, exponent - 1)
        return product(half, half)
    far = 1 << 40
    rows = []
    for to in range(4):  # the column of costs to end in `to`
        rows.append(closed([min((cost for _, cost, q in moves(symbol, state) if q == to), default=far) for state in range(4)]))
    return tuple(zip(*rows))


def product(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def times(matrix: tuple[Vector, ...], costs: Vector) -> Vector:
    return tuple(min(row[k] + costs[k] for k in range(4)) for row in matrix)


@lru_cache(maxsize=1 << 16)
def run_before(symbol: int, length: int, costs: Vector) -> Vector:
    """Costs before a run from the costs behind it."""
    exponent = 0
    while length:
        if length & 1:
            costs = times(power(symbol, exponent), costs)
        length >>= 1
        exponent += 1
    return costs


def run_matrix(symbol: int, length: int) -> tuple[Vector, ...]:
    columns = [run_before(symbol, length, tuple(0 if k == to else 1 << 40 for k in range(4))) for to in range(4)]
    return tuple(zip(*columns))


def before(symbol: int, length: int, costs: Vector) -> Vector:
    """run_before() with costs counted from the least one, so that the cache meets the same vectors again."""
    least = min(costs)
    return tuple(least + c for c in run_before(symbol, length, tuple(c - least for c in costs)))


def runs_of(symbols: list[int], counts: list[int]) -> list[list[int]]:
    """Runs [symbol, length] of rows of which each stands for its symbol once and for rows that must go the other times."""
    out: list[list[int]] = []
    for symbol, n in zip(symbols, counts):
        for s, length in ((symbol, 1), (0, n - 1)):
            if length and out and out[-1][0] == s:
                out[-1][1] += length
            elif length:
                out.append([s, length])
    return out


@lru_cache(maxsize=1 << 16)
def edit(symbol: int, state: int, here: Vector, behind: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to the use of a row, with the costs before and behind it; the state after them."""
    letters = ""
    while True:
        used = {letter: q for letter, cost, q in moves(symbol, state) if cost + behind[q] == here[state]}
        if "D" not in used and INSERT + here[NEXT[state]] == here[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        letter = min(used)
        return letters + letter, used[letter]


def unrolled(runs: list[list[int]], state: int, costs: Vector, last: bool) -> tuple[str, int, int]:
    """The cheapest edits of runs from a state, the costs behind them given, the state they end in and what they cost; `last` if the conversation ends there."""
    behind = [costs]
    for symbol, length in reversed(runs):
        behind.append(before(symbol, length, behind[-1]))
    behind.reverse()  # behind[i] now are the costs before run i
    parts, total = [], behind[0][state]
    for (symbol, length), costs_after in zip(runs, behind[1:]):
        if symbol == 0:  # every row goes, and an insert is never less than a deletion that must come anyway
            parts.append("D" * length)
            continue
        steps = [costs_after]
        for _ in range(length):
            steps.append(before(symbol, 1, steps[-1]))
        for here, after in zip(steps[:0:-1], steps[-2::-1]):
            least = min(after)
            letters, state = edit(symbol, state, tuple(c - least for c in here), tuple(c - least for c in after))
            parts.append(letters)
    if last:
        while not (state in ENDS and costs[state] == 0):
            parts.append("I")
            state = NEXT[state]
    return "".join(parts), state, total - costs[state]


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(placed, texts). placed: one row (chunk, at, conv, turn, role, mark, n, kind, symbol) for identical rows of a turn, `at` rising in order within and over chunks;
    `kind` is the first fault of the first of them. texts: (conv, turn, role, mark, text) of the same rows."""
    spark = rows.sparkSession
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    damaged = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    damaged = damaged.withColumn("mark", F.unhex(F.sha2("text", 256)))
    final = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(final == "", "blank").when(~final.isin(".", "!", "?"), "truncated").otherwise("")
    key = ["conv", "turn", "role", "mark"]
    same = materialise(damaged.withColumn("fault", fault).groupBy(*key, "fault").agg(F.count(F.lit(1)).alias("n")))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = same.groupBy("conv", "role", "mark").agg(F.min(place).alias("first"))
    on = F.expr("a.conv <=> b.conv AND a.role = b.role AND a.mark = b.mark")
    slim = same.alias("a").join(first.alias("b"), on).select("a.*", F.col("b.first").alias("first"))
    kind = F.when(F.col("fault") == "blank", "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate").otherwise(F.col("fault"))
    slim = slim.select(*key, "n", kind.alias("kind"))
    whose = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), initial(F.col("role"))), F.lit(0)), F.lit(4)).cast("int")
    whose = F.when(F.col("role") == "", 4).otherwise(whose)
    symbol = F.when(F.col("kind").isin("blank", "duplicate"), 0).otherwise(2 * whose - 1 + (F.col("kind") == "truncated").cast("int"))
    chunks = max(-(-same.count() // CHUNK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(c).asc_nulls_first() for c in key]
    placed = (slim.withColumn("symbol", symbol).repartitionByRange(chunks, *order).sortWithinPartitions(*order)
              .withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.spark_partition_id()))
    return materialise(placed), damaged.groupBy(*key).agg(F.min("text").alias("text"))


def groups_of(table: pa.Table) -> tuple[dict, list[tuple[int, int]]]:
    """Columns of a chunk in order as lists, and where each conversation starts and ends."""
    table = table.sort_by("at")
    columns = {name: table[name].to_pylist() for name in table.column_names}
    conv, out, start = columns["conv"], [], 0
    for i in range(1, len(conv) + 1):
        if i == len(conv) or conv[i] != conv[start]:
            out.append((start, i))
            start = i
    return columns, out


def cut_matrices(placed: DataFrame, kind: str) -> DataFrame:
    """(conv, chunk, matrix) of the first and last conversation of every chunk, the only ones that a cut can go through."""
    def run(table: pa.Table) -> pa.Table:
        columns, groups = groups_of(table)
        rows = []
        for start, end in {groups[0], groups[-1]}:
            matrix = tuple(tuple(0 if i == j else 1 << 40 for j in range(4)) for i in range(4))
            for symbol, length in runs_of(columns["symbol"][start:end], columns["n"][start:end]):
                matrix = product(matrix, run_matrix(symbol, length))
            rows.append((columns["conv"][start], columns["chunk"][start], [c for row in matrix for c in row]))
        return pa.table([pa.array([r[0] for r in rows], table.schema.field("conv").type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["conv", "chunk", "matrix"])

    return placed.select("chunk", "at", "conv", "n", "symbol").groupBy("chunk").applyInArrow(run, f"conv {kind}, chunk int, matrix array<long>")


def costs_behind(cuts: DataFrame, kind: str) -> DataFrame:
    """(chunk, conv, costs, first, last) for the conversations that lie in several chunks: the costs behind the chunk, and whether it is the first or last one."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "descending")])
        costs, out = END, []
        for flat in table["matrix"].to_pylist():
            out.append(costs)
            costs = times(tuple(tuple(flat[4 * i:4 * i + 4]) for i in range(4)), costs)
        n = len(out)
        return pa.table([table["chunk"], table["conv"], pa.array(out, pa.list_(pa.int64())), pa.array([i == n - 1 for i in range(n)]), pa.array([i == 0 for i in range(n)])], ["chunk", "conv", "costs", "first", "last"])

    several = cuts.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    cut = cuts.alias("a").join(several.alias("b"), F.expr("a.conv <=> b.conv")).select("a.*")
    return cut.groupBy("conv").applyInArrow(run, f"chunk int, conv {kind}, costs array<long>, first boolean, last boolean")


OUT = "array<struct<at: long, nth: int, role: string, turn: long, was: string, mark: binary>>"
COUNTS = "cost long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, opens string, closes string"


def parts(placed: DataFrame, behind: DataFrame, kind: str) -> DataFrame:
    """One row for each conversation, chunk that holds rows of it and state it may be in there: counts, edits, the state they lead to, and the rows that they leave."""
    schema = f"conv {kind}, chunk int, cut boolean, entry int, exit int, {COUNTS}, audit string, out {OUT}"

    def run(table: pa.Table, cuts: pa.Table) -> pa.Table:
        known = {c["conv"]: c for c in cuts.to_pylist()}
        rows: dict[str, list] = {name: [] for name in ("conv", "chunk", "cut", "entry", "exit", "cost", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "opens", "closes", "audit", "out")}
        columns, groups = groups_of(table) if table.num_rows else ({}, [])
        for start, end in groups:
            own = {name: values[start:end] for name, values in columns.items()}
            cut = known.get(own["conv"][0])
            facts = counted(own)
            entries = (0,) if cut is None or cut["first"] else (0, 1, 2, 3)
            costs, last = (END, True) if cut is None else (tuple(cut["costs"]), cut["last"])
            runs = runs_of(own["symbol"], own["n"])
            for entry in entries:
                audit, state, cost = unrolled(runs, entry, costs, last)
                for name, value in {"conv": own["conv"][0], "chunk": own["chunk"][0], "cut": cut is not None, "entry": entry, "exit": state, "cost": cost, **facts, "audit": audit, "out": left(own, audit, entry)}.items():
                    rows[name].append(value)
        types = {"conv": table.schema.field("conv").type if table.num_rows else cuts.schema.field("conv").type, "chunk": pa.int32(), "cut": pa.bool_(), "entry": pa.int32(), "exit": pa.int32(), "audit": pa.string(), "opens": pa.string(), "closes": pa.string(),
                 "out": pa.list_(pa.struct([("at", pa.int64()), ("nth", pa.int32()), ("role", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("mark", pa.binary())]))}
        return pa.table([pa.array(values, types.get(name, pa.int64())) for name, values in rows.items()], list(rows))

    return placed.groupBy("chunk").cogroup(behind.groupBy("chunk")).applyInArrow(run, schema)


def counted(own: dict[str, list]) -> dict:
    """Faults, illegal neighbours and turns among the rows of a conversation in a chunk."""
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    for kind, n in zip(own["kind"], own["n"]):
        if kind:
            faults[kind] += 1
        faults["blank" if kind == "blank" else "duplicate"] += n - 1
    initials = [role[:1] for role in own["role"]]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])) + sum(n - 1 for n in own["n"])
    turns = [t for t in own["turn"] if t is not None]
    return faults | {"illegal": illegal, "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None), "opens": initials[0], "closes": initials[-1]}


def left(own: dict[str, list], audit: str, state: int) -> list[dict]:
    """The rows that the edits leave. The text of a kept row is found by turn, role and mark; an inserted row has none."""
    out, letters = [], iter(audit)
    nth = at = 0
    for i, n in enumerate(own["n"]):
        at, nth, used = own["at"][i], 0, 0
        while used < n:
            letter = next(letters)
            if letter == "D":
                used += 1
                continue
            state = {"s": 1, "u": 2, "a": 3}[own["role"][i][:1]] if letter == "K" else NEXT[state]
            kept = letter != "I"
            used += kept
            out.append({"at": at, "nth": nth, "role": own["role"][i] if letter == "K" else NAMES[state], "turn": own["turn"][i] if kept else None, "was": own["role"][i] if kept else None, "mark": own["mark"][i] if kept else None})
            nth += 1
    for _ in letters:  # inserts at the end
        state = NEXT[state]
        out.append({"at": at, "nth": nth, "role": NAMES[state], "turn": None, "was": None, "mark": None})
        nth += 1
    return out


def chosen(found: DataFrame, kind: str) -> DataFrame:
    """The parts of the states that conversations are really in when they come to a chunk."""
    def run(table: pa.Table) -> pa.Table:
        ways: dict[int, dict[int, int]] = {}
        for chunk, entry, state in zip(table["chunk"].to_pylist(), table["entry"].to_pylist(), table["exit"].to_pylist()):
            ways.setdefault(chunk, {})[entry] = state
        state, out = 0, []
        for chunk in sorted(ways):
            out.append((chunk, state))
            state = ways[chunk][state]
        return pa.table([pa.array([table["conv"][0].as_py()] * len(out), table.schema.field("conv").type), pa.array([c for c, _ in out], pa.int32()), pa.array([e for _, e in out], pa.int32())], ["conv", "chunk", "entry"])

    taken = found.where("cut").select("conv", "chunk", "entry", "exit").groupBy("conv").applyInArrow(run, f"conv {kind}, chunk int, entry int")
    cut = found.where("cut").alias("a").join(taken.alias("b"), F.expr("a.conv <=> b.conv AND a.chunk = b.chunk AND a.entry = b.entry"), "left_semi")
    return found.where("NOT cut").unionByName(cut)


class Repair:
    """The repair of a table of conversations: `summary()` has a row for each conversation, `rows()` the repaired rows."""

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        """Nulls in role and text count as one space; rows without a conversation are one conversation of id null, rows without a turn come first in theirs.
        Rows of one turn are in order of role, then of the SHA-256 of their text. Other columns are not read; an empty table gives no rows."""
        kind = rows.schema[conv_col].dataType.simpleString()
        placed, self.texts = ordered(rows, conv_col, turn_col, role_col, text_col)
        behind = costs_behind(materialise(cut_matrices(placed, kind)), kind)
        self.parts = materialise(chosen(materialise(parts(placed, behind, kind)), kind))

    def summary(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation with rows."""
        names = ["cost", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "opens", "closes", "audit"]
        whole = self.parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", *names))).alias("p"))
        # What two chunks share: a turn that goes on, and the neighbours at the cut.
        pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.struct(
            (F.coalesce(a["high"] == b["low"], F.lit(False))).cast("long").alias("turn"), (~F.concat(a["closes"], b["opens"]).isin("su", "ua", "au")).cast("long").alias("illegal")))
        total = lambda rows, name: F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + r[name])  # noqa: E731
        low, high = F.array_min(F.transform("p", lambda r: r["low"])), F.array_max(F.transform("p", lambda r: r["high"]))
        gaps = F.coalesce(high - low + 1 - (total(F.col("p"), "turns") - total(F.col("pairs"), "turn")), F.lit(0)).cast("long")
        return whole.withColumn("pairs", pairs).select(
            "conv", gaps.alias("gaps"), *[total(F.col("p"), n).alias(n) for n in ("blank", "duplicate", "truncated")],
            (total(F.col("p"), "illegal") + total(F.col("pairs"), "illegal")).alias("illegal"), total(F.col("p"), "cost").alias("cost"), F.array_join(F.transform("p", lambda r: r["audit"]), "").alias("audit"))

    def rows(self) -> DataFrame:
        """(conv, at, nth, role, text, turn): the repaired conversations, their rows in order of (at, nth). Inserted rows have an empty text and no turn."""
        out = self.parts.select("conv", F.explode("out").alias("o")).select("conv", "o.*")
        kept = (out.where("was IS NOT NULL").alias("a").join(self.texts.alias("b"), F.expr("a.conv <=> b.conv AND a.turn <=> b.turn AND a.was = b.role AND a.mark = b.mark"))
                .select("a.conv", "a.at", "a.nth", "a.role", "b.text", "a.turn"))
        return kept.unionByName(out.where("was IS NULL").select("conv", "at", "nth", "role", F.lit("").alias("text"), "turn"))


def hashed(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of `role:text` of a conversation's rows, joined by newlines. Rows stream through the hash; no task holds a conversation."""
    kind = rows.schema["conv"].dataType.simpleString()
    dealt = rows.select("conv", "at", "nth", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "at", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, some, type_ = None, None, False, None
        made: list[list] = [[], []]

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(made[0], type_), pa.array(made[1], pa.string())], ["conv", "sha256"])
            made[0], made[1] = [], []
            return out

        for rows_ in batches:
            type_ = rows_.schema.field("conv").type
            for own, line in zip(rows_["conv"].to_pylist(), rows_["line"].to_pylist()):
                if some and own == conv:
                    digest.update(b"\n")
                else:
                    if some:
                        made[0].append(conv)
                        made[1].append(digest.hexdigest())
                    conv, digest, some = own, hashlib.sha256(), True
                digest.update(line.encode())
            if made[0]:
                yield batch()
        if some:
            made[0].append(conv)
            made[1].append(digest.hexdigest())
            yield batch()

    return dealt.select("conv", "line").mapInArrow(run, f"conv {kind}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by a checksum of conversation and turn: 0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question
    marks away, 3 repeats it, 4 makes its role user; others stay."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def report(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `rows`, which are damaged first: gaps, faults, cost, audit and digest of the repair. Conversations that the damage leaves
    without rows have zeros, no audit and the digest of nothing. See Repair for nulls and ties."""
    repair = Repair(damaged(rows))
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    match = F.expr("a.conv <=> b.conv")
    # The digest is also the rows' way through the join: conversations of which nothing is left have no rows.
    found = every.alias("a").join(repair.summary().alias("b"), match, "left").select("a.conv", *[F.col(f"b.{c}") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])
    found = found.alias("a").join(hashed(repair.rows()).alias("b"), match, "left")
    audit = F.coalesce("audit", F.lit(""))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("a.conv").alias("conv_id"), *zero, audit.alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same in DuckDB: the suffix of least cost, then least audit, of each state, from a conversation's last row to its first."""
    way = lambda cost, letter, line, rest: f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 'r': {line} || {rest}.r}}"  # noqa: E731
    named = {q: f"'{name}:' || chr(10)" for q, name in NAMES.items()}
    text = "d.text || chr(10)"
    uses = []
    for q in range(4):
        kept = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[q]
        keep = " ".join(f"WHEN NOT d.must AND d.role[1] = '{k}' THEN {way('d.late', 'K', f'd.role || chr(58) || {text}', f's{to}')}" for k, to in kept)
        rerole = f"CASE WHEN NOT d.must THEN {way(f'{REROLE} + d.late', 'R', f"'{NAMES[NEXT[q]]}:' || {text}", f's{NEXT[q]}')} END"
        uses.append(f"list_min([{way(DELETE, 'D', "''", f's{q}')}, CASE {keep} END, {rerole}]) AS b{q}")
    insert = lambda own, then, q: f"list_min([{own}, {way(INSERT, 'I', named[q], then)}])"  # noqa: E731
    end = lambda cost, audit, rest: f"{{'c': {cost}::BIGINT, 'a': '{audit}', 'r': {rest}}}"  # noqa: E731
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
damaged AS (
  SELECT conv_id, turn, fault, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text
  FROM (SELECT *, coalesce(text, ' ') AS t, xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS fault FROM conversations CROSS JOIN crc)
  WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN count(*) OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' ELSE '' END AS kind, lead(role) OVER (PARTITION BY conv_id ORDER BY i) AS after
  FROM placed),
d AS MATERIALIZED (SELECT *, kind IN ('blank', 'duplicate') AS must, (kind = 'truncated')::BIGINT AS late FROM faults),
rec AS (
  SELECT conv_id, max(i) + 1 AS i, {end(0, '', "''")} AS s0, {end(2 * INSERT, 'II', f'{named[2]} || {named[3]}')} AS s1, {end(INSERT, 'I', named[3])} AS s2, {end(0, '', "''")} AS s3
  FROM d GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {insert('b0', 'e2', 2)}, {insert('b1', 'e2', 2)}, e2, e3
  FROM (SELECT *, {insert('b2', 'b3', 3)} AS e2, {insert('b3', 'b2', 2)} AS e3
        FROM (SELECT rec.conv_id, d.i, {', '.join(uses)} FROM rec JOIN d ON rec.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = rec.i - 1))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
    count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (after IS NOT NULL AND role[1] || after[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM d GROUP BY conv_id)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(left(s0.r, greatest(length(s0.r) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every
LEFT JOIN counts ON every.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN (SELECT * FROM rec WHERE i = 1) done ON every.conv_id IS NOT DISTINCT FROM done.conv_id"""


#: The same for the table of conversations in DuckDB.
SQL = _sql()
