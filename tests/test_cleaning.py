import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from affinis.functions.numbers import count_from_text, finite_columns
from affinis.functions.text import BLANKS, strip, strip_bare
from affinis.functions.times import valid_iso
from affinis.operators import cleaning as cl

SCHEMA = ("entity_name string, entity_slug string, total_n string, tag_name string, tag_slug string, tag_n string, "
          "source_type string, observed_at string, row int")
TS = "2026-05-07T00:00:00+00:00"


def raw(row, slug="alpha", total="100", tag="tokens", n="10", source="commander_json", ts=TS, name=None):
    return (name or slug.title() if slug else name, slug, total, tag.title(), tag, n, source, ts, row)


def run(spark, normal, signal=(), known=("alpha", "beta")):
    index = spark.createDataFrame([(k,) for k in known], "entity_slug string")
    bag = cl.union_inputs([("normal", spark.createDataFrame(list(normal), SCHEMA), ["row"]),
                           ("signal", spark.createDataFrame(list(signal), SCHEMA), ["row"])])
    checked = cl.check_rows(bag, index)
    return cl.clean(checked, ["input_rank", "input_row"]), index


def test_union_normalises_and_joins_signal_rows(spark):
    result, _ = run(spark, [raw(1, total=" 1,000 ", n="1,0")], [raw(1, tag="anything", n="7", source="cedh_filtered_json")])
    got = {r["tag_slug"]: r for r in result.clean.collect()}
    assert got["tokens"]["total_n"] == 1000 and got["tokens"]["tag_n"] == 10
    assert got["cedh"]["tag_name"] == "cEDH"


@pytest.mark.parametrize("change, reason", [
    ({"slug": "\t "}, "entity_slug:blank"), ({"total": "0"}, "total_n:not_positive"), ({"total": "many"}, "total_n:not_a_count"),
    ({"n": "-1"}, "tag_n:negative"), ({"n": "101"}, "tag_n:above_total_n"), ({"source": "other"}, "source_type:unexpected"),
    ({"ts": "2026"}, "observed_at:not_iso"), ({"total": "3.7", "n": "x"}, "total_n:not_a_count, tag_n:not_a_count"),
])
def test_broken_rows_are_set_aside(spark, change, reason):
    result, _ = run(spark, [raw(1), raw(2, **({"name": "N"} | change))])
    bad = result.invalid.collect()
    assert [(b["reason_type"], b["reason"], b["input_source"], b["input_row"]) for b in bad] == [(cl.SCHEMA_ERROR, reason, "normal", 2)]
    assert '"row":2' in bad[0]["raw_record"]


def test_unknown_entity_is_only_asked_of_good_rows(spark):
    result, _ = run(spark, [raw(1, slug="gone"), raw(2, slug="gone", total="0")])
    assert {r["input_row"]: r["reason_type"] for r in result.invalid.collect()} == {1: cl.UNKNOWN_ENTITY, 2: cl.SCHEMA_ERROR}


def test_copies_conflicts_and_first_rows(spark):
    rows = [raw(1, n="10"), raw(2, n="10"), raw(3, n="20"), raw(4, n="10"), raw(5, tag="other")]
    result, index = run(spark, rows)
    assert {(r["tag_slug"], r["tag_n"]) for r in result.clean.collect()} == {("tokens", 10), ("other", 10)}
    assert result.exact_duplicates.count() == 2
    assert sorted(r["tag_n"] for r in result.conflicts.collect()) == [10, 20]
    report = cl.validation_report(result, index).first()
    assert (report["clean_tag_row_count"], report["exact_duplicate_row_count"], report["conflicting_duplicate_key_count"]) == (2, 2, 1)
    # every input row is clean, a copy, a losing version or invalid
    assert report["total_input_row_count"] == 2 + 2 + (2 - 1) + 0
    assert report["warnings"] == ["rows conflict on entity, tag and source"]


def test_normal_row_comes_before_signal_row(spark):
    result, _ = run(spark, [raw(9, tag="cedh", n="5")], [raw(1, n="6", source="cedh_filtered_json")])
    assert result.clean.count() == 2  # the source is part of the key
    entity = cl.entities(result.clean).first()
    assert (entity["tag_count"], entity["normal_tag_count"], entity["has_cedh_tag"], entity["cedh_n"]) == (2, 1, True, 6)
    tag = cl.tags(result.clean).first()
    assert (tag["entity_count"], tag["total_tag_n"], tag["source_types"]) == (1, 11, ["cedh_filtered_json", "commander_json"])


def test_status_counts_and_warning(spark):
    status = spark.createDataFrame([("http_error",), (" ",), (None,), ("no_cedh_route",)], "status_type string")
    assert {r["status_type"]: r["row_count"] for r in cl.status_counts(status).collect()} == {"http_error": 1, "unknown": 2, "no_cedh_route": 1}
    result, index = run(spark, [raw(1)])
    assert cl.validation_report(result, index, status).first()["warnings"] == ["signal statuses hold errors"]


def test_counts_of_typed_columns(spark):
    df = spark.sql("select true as b, 3.7D as d, 5 as i, ' 1,234 ' as s, parse_json('4.9') as v, parse_json('true') as w")
    types = {f.name: f.dataType for f in df.schema.fields}
    from affinis.functions.numbers import count_of
    assert df.select(*[count_of(c, types[c]) for c in df.columns]).first()[:] == (None, 3, 5, 1234, 4, None)
    assert spark.range(1).select(count_from_text(F.lit("3.7")), count_from_text(F.lit(""))).first()[:] == (None, None)


@pytest.mark.parametrize("text, good", [
    ("2026-05-07", True), ("2026-05-07T10:20:30.5+02:00", True), ("2026-05-07T10:20:30Z", True), ("20260507", True), ("2026-W19-4", True),
    ("2026", False), ("2026-05", False), ("2026-02-30", False), ("yesterday", False), ("2026-05-07T25:00", False), ("", False),
])
def test_iso_check(spark, text, good):
    assert spark.range(1).select(valid_iso(F.lit(text))).first()[0] is good


def test_not_a_number_becomes_null_at_any_depth(spark):
    df = spark.sql("select double('NaN') as a, array(struct(double('Infinity') as x, 1 as y)) as b, map('k', double('-Infinity')) as c, 2.5D as d")
    got = finite_columns(df).first()
    assert got["a"] is None and got["b"][0]["x"] is None and got["b"][0]["y"] == 1 and got["c"] == {"k": None} and got["d"] == 2.5


@pytest.mark.parametrize("text, good", [
    ("2026-05-7T", False), ("2026-05-7 ", False), (" 026-05-07", False), ("+026-05-07", False), ("-026-05-07", False), ("2026-13-01", False), ("2024-02-29", True),
    ("2023-02-29", False), ("2026-5--07", False), ("2026-05-0x", False), ("0000-01-01", True), ("2026-05-07 ", False), ("2026-05-\u0660\u0667", False),
])
def test_iso_check_of_texts_as_long_as_a_day(spark, text, good):
    assert spark.range(1).select(valid_iso(F.lit(text))).first()[0] is good


def test_bare_texts_are_stripped_as_others_are(spark):
    texts = ["", "a", "ab", "~", "!", "\x7f", "a\x7f", "\u00e9", "a\u00e9", "\u00e9a", "a b", None, *BLANKS]
    texts += [x for b in BLANKS for x in (b + "a", "a" + b, b + "a" + b, "a" + b + "a", "\u00e9" + b, b + b)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip_bare("t")).collect()] == [r[0] for r in df.select(strip("t")).collect()]


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_good_rows_pass_the_slow_steps_by(spark):
    """the list of broken rules is made for broken rows only, blanks are searched for where an end may be blank, and one sort serves copies and first rows."""
    result, _ = run(spark, [raw(1), raw(2, n="20"), raw(3, n="20"), raw(4, slug=" beta ", total="0", n="-1")])
    checked, clean = plan_of(result.checked), plan_of(result.clean)
    assert "THEN transform(array(" in checked and re.search(r"THEN entity_slug#\d+ ELSE trim\(entity_slug#\d+", checked)
    grouped = clean.split("Join", 1)[0]  # the join has dealt the rows by entity already
    assert grouped.count("SortAggregate") == 4 and len(re.findall(r"\bSort \[", grouped)) == 1
    assert [r["tag_n"] for r in result.clean.collect()] == [10]
    assert result.invalid.first()["reason"] == "total_n:not_positive, tag_n:negative" and result.exact_duplicates.count() == 1
