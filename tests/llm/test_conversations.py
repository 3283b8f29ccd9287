import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import check
from affinis.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, at string, chunk string, mark string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "n") for r in rows], SCHEMA).repartition(3)


def space(v):
    return " " if v is None else str(v)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def order(r):
    return r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit) by plain recursion over rows and states, at most three inserts at one place."""
    following = {0: 2, 1: 2, 2: 3, 3: 2}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if inserts < 3:
            cost, audit = best(i, following[state], inserts + 1)
            ways.append((cost + 2, "I" + audit))
        if i == len(rows):
            if state in (0, 3):
                ways.append((0, ""))
            return min(ways, default=(10 ** 9, ""))
        cost, audit = best(i + 1, state, 0)
        ways.append((cost + 3, "D" + audit))
        if faults[i] not in ("blank", "duplicate"):
            late, role = int(faults[i] == "truncated"), rows[i][2][:1]
            if role == "s" and state == 0 or role == "u" and state != 2 or role == "a" and state == 2:
                cost, audit = best(i + 1, {"s": 1, "u": 2, "a": 3}[role], 0)
                ways.append((cost + late, "K" + audit))
            cost, audit = best(i + 1, following[state], 0)
            ways.append((cost + late + 2, "R" + audit))
        return min(ways)

    return best(0, 0, 0)


def applied(rows, audit):
    out, i, state = [], 0, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        state = {"s": 1, "u": 2, "a": 3}[rows[i][2][0]] if letter == "K" else 3 if state == 2 else 2
        role = rows[i][2] if letter == "K" else cv.NAMES[state]
        out.append(f"{role}:{'' if letter == 'I' else rows[i][3]}")
        i += letter != "I"
    assert i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in out))
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=order)
        faults, turns = faults_of(own), [r[1] for r in own if r[1] is not None]
        cost, audit = cheapest(own, faults)
        initials = [r[2][:1] for r in own]
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "repaired_sha256": applied(own, audit)}
    return out


def talk(seed, conversations=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(0, longest)):
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "a"])
                text = rng.choice(["One.", "Two!", "three", "four?\x0b", " ", "", None, "Ein é.\n", "\x1f", f"{rng.random()}."])
                rows.append((conv if conv else None, rng.choice([turn, turn, turn, 3 * turn, None]), role, text))
    return rows


def got_of(frame_):
    return {r["conv_id"]: r.asDict() for r in cv.report(frame_).collect()}


def test_matches_brute_force(spark):
    rows = talk(1) + [(500, 1, "user", "Same."), (500, 1, "user", "Same.")] * 3
    got, want = got_of(frame(spark, rows)), brute(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], [r for r in rows if r[0] == conv]


def test_cut_conversations_match_too(spark, monkeypatch):
    """Chunks of a few rows cut most conversations, one of them many times."""
    monkeypatch.setattr(cv, "CHUNK", 7)
    rng = random.Random(5)
    rows = talk(2, 12, 25) + [(77, i // 2, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{i}.", f"{i}"])) for i in range(150)]
    got, want = got_of(frame(spark, rows)), brute(rows)
    assert got == want


def test_cheapest_edits_are_those_of_a_full_search():
    """All edit strings of short conversations, priced one by one."""
    def price(symbols, letters):
        i = state = cost = 0
        for letter in letters:
            if letter == "I":
                state, cost = cv.NEXT[state], cost + 2
                continue
            if i == len(symbols):
                return None
            ways = {m: (c, q) for m, c, q in cv.moves(symbols[i], state)}
            if letter not in ways:
                return None
            cost, state, i = cost + ways[letter][0], ways[letter][1], i + 1
        return cost if i == len(symbols) and state in cv.ENDS else None

    rng = random.Random(9)
    for _ in range(60):
        symbols = [rng.randrange(9) for _ in range(rng.randint(0, 3))]
        words = ("".join(w) for n in range(len(symbols) + 4) for w in itertools.product("DIKR", repeat=n))
        want = min((c, w) for w in words if (c := price(symbols, w)) is not None)
        audit, _, cost = cv.unrolled(cv.runs_of(symbols, [1] * len(symbols)), 0, cv.END, True)
        assert (cost, audit) == want, symbols


def test_runs_are_advanced_by_powers():
    rng = random.Random(3)
    for _ in range(100):
        symbol, n, costs = rng.randrange(9), rng.randint(1, 300), cv.END
        for _ in range(n):
            costs = cv.times(cv.power(symbol, 0), costs)
        assert cv.run_before(symbol, n, cv.END) == costs == cv.times(cv.run_matrix(symbol, n), cv.END)
    assert len(cv.runs_of([3, 3, 3, 0, 5], [1, 1, 4, 2, 1])) == 3


def test_many_equal_rows_and_very_long_texts(spark):
    rows = [(1, 0, "user", "x" * 200_000 + "."), (1, 2, "assistant", "Done.")] + [(2, 4, "user", "Again.")] * 5_000
    assert got_of(frame(spark, rows)) == brute(rows)


def test_repaired_rows_and_empty_table(spark):
    rows = frame(spark, [(9, 0, "user", "Hi."), (9, 2, "user", "Hi."), (9, 3, "tool", "Yes."), (9, 4, "user", "And?")])
    repair = cv.Repair(rows)
    got = [(r["role"], r["text"], r["turn"]) for r in repair.rows().orderBy("at", "nth").collect()]
    assert got == [("user", "Hi.", 0), ("assistant", "Yes.", 3), ("user", "And?", 4), ("assistant", "", None)]
    assert repair.summary().first()["audit"] == "KDRKI"
    none = rows.where("false")
    assert cv.report(none).count() == 0 and cv.Repair(none).rows().count() == 0


def test_conversations_that_lose_all_rows(spark):
    conv = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = cv.report(frame(spark, [(conv, 0, "user", "Hi.")])).collect()
    assert row.asDict() == {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_registered_query_matches_brute_force(spark):
    from affinis.llm.queries import QUERIES
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: r.asDict() for r in QUERIES["op12_conversation_repair"](spark, folder).collect()} == brute(rows)


def test_sql_gives_the_same_rows(spark):
    folder = "/root/testdata/sf0.001"
    assert check.compare(spark, check.connect(folder), folder, "op12_conversation_repair")[0] is None
