"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score, spans can be blanked.

Patterns only look at the text itself, so every document is handled whole where it is read; nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from affinis.llm.batches import map_rows, texts_of

#: Kinds in the order in which spans that start together are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

#: What a pattern is worth by itself, once its validator has confirmed it.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.8, "ssn": 0.3}

#: Words that speak for a kind when they stand nearby.
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("address", "host", "server", "ip"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security", "insurance"),
}
#: Code points looked at on either side, what a context word adds, and what an added span needs. Base spans need nothing more.
NEAR, BONUS, ENOUGH = 40, 0.4, 0.65

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Signs of an IBAN by country, as registered.
IBAN_SIGNS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, its own digits summed, in all a multiple of ten."""
    total = sum(map(int, digits[::-1][::2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2])
    return total % 10 == 0


def mod97(text: str) -> bool:
    """First four signs moved to the end, letters as 10 to 35, remainder 1 by 97."""
    sign = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in sign[4:] + sign[:4])) % 97 == 1


def small_parts(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def emails(text: str):
    """Around each @ that has a domain after it, the local part before it, as far as the last address reached."""
    floor = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            floor = m.end()


def matches(pattern: re.Pattern, text: str, confirm):
    return ((m.start(), m.end()) for m in pattern.finditer(text) if confirm(m.group()))


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the IBAN that begins a candidate span ends: at the length of its country, in any other country at the last end of a word that mod-97 confirms."""
    signs = IBAN_SIGNS.get(text[start:start + 2])
    while end > start:
        n = end - start - text.count(" ", start, end)
        if n < 15:
            return None
        if signs in (None, n) and mod97(text[start:end]):
            return end
        end = text.rfind(" ", start, end)
    return None


def ibans(text: str):
    """Each IBAN from left to right; after a candidate that is none, the search goes on at the next word."""
    at = 0
    while m := IBAN.search(text, at):
        end = iban_end(text, m.start(), m.end())
        if end is not None:
            yield m.start(), end
        at = end or m.start() + 1


def count_ok(text: str, low: int, high: int) -> str | None:
    digits = NOT_DIGIT.sub("", text)
    return digits if low <= len(digits) <= high else None


def card_ok(text: str) -> bool:
    digits = count_ok(text, 14, 19)
    return digits is not None and luhn(digits)


def spans_of(text: str) -> list[dict]:
    """All spans of a text, by start, then kind as listed."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [("ip", *s) for s in matches(IP, text, small_parts)]
        found += [("card", *s) for s in matches(CARD, text, card_ok)]
        found += [("phone", *s) for s in matches(PHONE, text, lambda t: count_ok(t, 10, 15))]
        found += [("iban", *s) for s in ibans(text)]
        found += [("ssn", *s) for s in matches(SSN, text, lambda t: True)]
    out = []
    for kind, start, end in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))):
        around = (text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]).lower()
        score = min(1.0, WORTH[kind] + BONUS * any(word in around for word in CONTEXT[kind]))
        base = kind in BASE_KINDS
        if base or score >= ENOUGH:
            out.append({"kind": kind, "start": start, "end": end, "score": score, "base": base})
    return out


def blanked(text: str, spans: list[dict]) -> str:
    """The text with each maximal run of spans replaced by the kind of its first, as [EMAIL]."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of `docs`; start and end count code points, end exclusive.

    A null or empty text has no spans. Ids may be null or repeat: there is one row for each row given. Other columns are
    not read. An empty table gives no rows.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch[0], pa.array([spans_of(t) for t in texts_of(batch, "text")], type=SPAN_TYPE)], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, f"id {kind}, spans {SPANS}", "text").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs`, all columns and rows, with the spans in its texts blanked. Null texts stay null, whatever the id; an empty table stays empty."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        new = pa.array([t and blanked(t, spans_of(t)) for t in batch[at].to_pylist()], type=batch.schema.field(at).type)
        return batch.set_column(at, batch.schema.field(at), new)

    return map_rows(docs, run, docs.schema, text_col)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans with their scores, by document."""
    base = F.filter("spans", lambda s: s["base"])
    return find(docs).select(
        "doc_id", *[counted(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
