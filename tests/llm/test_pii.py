import hashlib
import random
import re

from affinis.llm import pii
from helpers import ODD_TEXTS, empty, frame

#: The base kinds as plain patterns, searched from left to right.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if holds(k, m.group())]
    return [f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda f: (f[0], list(PLAIN).index(f[1])))]


def listed(spans):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.z", "@q.r", "..", "1.2.3.4", "255.256.1.1", "0001.2.3.4.5", "4111111111111111", "4111 1111-1111 1111", "+1 (988) 555-2485", "+", "-", " ", "12", "é", "\n", "9" * 20, "+49.30 (12)34567"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert listed(s for s in pii.spans_of(text) if s["base"]) == brute(text), text


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88370400440532013000")


def test_added_spans_need_a_checksum_or_words_nearby():
    kinds = lambda text: [s["kind"] for s in pii.spans_of(text)]
    assert kinds("IBAN DE89370400440532013000.") == ["iban"]
    assert kinds("DE88370400440532013000") == []
    assert kinds("ref 123-45-6789 of the part") == [] and kinds("her SSN 123-45-6789") == ["ssn"]
    low, high = (pii.spans_of(t)[0]["score"] for t in ("see 10.1.2.3", "server address 10.1.2.3"))
    assert low < high <= 1


def test_ibans_among_other_capital_words():
    found = lambda text: [text[s["start"]:s["end"]] for s in pii.spans_of(text) if s["kind"] == "iban"]
    gb, de, no = "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO9386011117947"
    for iban in (gb, gb.replace(" ", ""), de, "DE89 3704 0044 0532 0130 00", no, "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for after in ("", ".", " BY Friday", " 2024", " AND NOT 1 DAY LATER", " " + "A " * 40, " " + "9" * 40):
            assert found(f"IBAN {iban}{after}") == [iban], (iban, after)
    assert found(f"{gb} {de} {no} {gb}") == [gb, de, no, gb]
    assert found(f"REF AB12 CODE X {de} 2024") == [de]
    assert found(f"GB82 WEST 1234 5698 7654 33 {gb} OK") == [gb]
    assert found(f"x{de} {de}x {de}2024") == []
    text = f"IBAN {gb} BY Friday"
    assert pii.blanked(text, pii.spans_of(text)) == "IBAN [IBAN] BY Friday"
    for text in ("AB12 " * 40_000, "GB82 WEST 1234 5698 " * 10_000):
        assert found(text) == []


def test_ibans_of_unlisted_countries_end_at_a_word():
    check = next(f"{k:02}" for k in range(2, 99) if pii.mod97(f"QQ{k:02}00001111222233"))
    iban = f"QQ{check} 0000 1111 2222 33"
    wrong = [w for w in ("BY", "AT", "TO") if not pii.mod97(f"{iban} {w}")]
    for word in wrong:
        assert [t[s["start"]:s["end"]] for t in [f"bank {iban} {word} noon"] for s in pii.spans_of(t)] == [iban]


def test_very_long_runs_take_no_square_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 50_000, "@" * 100_000, "a@" * 50_000):
        pii.spans_of(text)


def test_query_rows(spark):
    texts = [*ODD_TEXTS, "mail bo.b@x.example.com, +1 (988) 555-2485 or 10.0.0.255; IBAN DE89370400440532013000"]
    got = {r["doc_id"]: r for r in pii.report(frame(spark, texts, ("spans", "id", "scores"))).collect()}
    for i, text in enumerate(texts):
        want = brute(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w.startswith(k) for w in want) for k in PLAIN]
    assert set(got[len(texts) - 1]["spans"].split(",")) > set(brute(texts[-1]))
    assert pii.report(empty(spark)).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = frame(spark, [None, "", "to a@b.c now", "a@b.c"], ("spans",))
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: None, 1: "", 2: "to [EMAIL] now", 3: "[EMAIL]"}
