import random
import re

import pytest
from helpers import ODD_TEXTS, empty
from pyspark.sql import functions as F

import check
from affinis.llm import rules

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)]


def texts(seed, count=120):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        words = [rng.choice(["a", "be", "c#", "ä|", "𝒳x", "d$<", "e"]) for _ in range(rng.choice([0, 3, 7, 8, 9, 16, 40, 120]))]
        block = words[:rng.choice([2, 8, 11])]
        for _ in range(rng.choice([0, 0, 1, 3])):
            at = rng.randint(0, len(words))
            words[at:at] = block
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t", "\x0b", "\r\n", "\x0c", "\x1f ", " "]) for w in words))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, n string, level int, bucket long, documents long, kept boolean, at0 string").repartition(3)


def rows_of(texts, lang="en", source="s"):
    return [(i, t, lang, source, "x", "y", 1, 2, 3, False, "z") for i, t in enumerate(texts)]


def test_counts_are_those_of_brute_force(spark):
    tried = texts(4) + ODD_TEXTS[:6] + ["x" * 30_000, "a b " * 300, "one two three four five six seven eight " * 2]
    got = {r["doc_id"]: r for r in rules.judged(frame(spark, rows_of(tried))).collect()}
    assert len(got) == len(tried)
    for i, t in enumerate(tried):
        want = brute(t)
        assert [got[i][c] for c in NAMES] == want, t
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_very_long_text(spark):
    (row,) = rules.judged(frame(spark, rows_of(["a b " * 200_000]))).collect()
    assert row["n_words"] == row["n_repeat_words"] == 400_000 and row["base_failed"]


def test_buckets_keep_seven_digits(spark):
    values = [0, 1, 127, 128, 129, 255, 256, 1000, 5023, 10 ** 9 + 7]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(rules.bucket(F.col("v"))).collect()]
    assert got == [v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7) for v in values]


def words(rng, n, symbol_share):
    return " ".join(f"w{rng.randrange(10 ** 6)}" + ("#" if rng.random() < symbol_share else "") for _ in range(n))


def test_thresholds_follow_language_and_source(spark):
    """A source full of symbols keeps its own texts; the same text elsewhere goes. Small sources take the language's thresholds, small languages those of all."""
    rng = random.Random(8)
    rows = [(words(rng, 60, 0.5), "en", "code") for _ in range(150)] + [(words(rng, 60, 0), "en", "prose") for _ in range(400)]
    rows += [(words(rng, 60, 0.5), "en", "prose"), (words(rng, 60, 0.5), "en", "rare"), (words(rng, 60, 0), "en", "rare"), (words(rng, 60, 0), None, None), (words(rng, 60, 0.9), None, None)]
    docs = frame(spark, [(i, t, lang, source, "x", "y", 1, 2, 3, False, "z") for i, (t, lang, source) in enumerate(rows)])
    measured = rules.materialise(rules.measured(docs))
    found = {(r["lang"], r["source"]): r for r in rules.thresholds(measured).collect()}
    assert {k: r["level"] for k, r in found.items()} == {("en", "code"): 0, ("en", "prose"): 0, ("en", "rare"): 1, ("", ""): 2}
    symbols = {}
    for r in measured.collect():
        assert not r["base_failed"]
        for group in ((r["lang"], r["source"]), (r["lang"],), ()):
            symbols.setdefault(group, []).append(r["symbols"] >> max(0, r["symbols"].bit_length() - 7) << max(0, r["symbols"].bit_length() - 7))
    for key, group in ((("en", "code"), ("en", "code")), (("en", "prose"), ("en", "prose")), (("en", "rare"), ("en",)), (("", ""), ())):
        values = sorted(symbols[group])
        q1, q3 = (values[-(-k * len(values) // 4) - 1] for k in (1, 3))
        assert found[key]["high_symbols"] == q3 + 3 * max(q3 - q1, rules.MEASURES["symbols"])
    kept = [r["kept"] for r in rules.judged(docs).orderBy("doc_id").collect()]
    assert all(kept[:550]) and kept[550:] == [False, found["en", "rare"]["high_symbols"] >= 500, True, True, found["", ""]["high_symbols"] >= 900]


def test_merged_sketches_do_not_depend_on_the_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (sorted(map(tuple, rules.judged(d).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many and len(one) == docs.count()


def test_empty_table_repeated_and_null_ids(spark):
    none = empty(spark).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    assert rules.judged(none).count() == 0
    twice = spark.createDataFrame([(None, "a", None, "s"), (None, "a", None, "s"), (1, "b", "en", None), (1, "c", "en", None)], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in rules.judged(twice).collect()] == [False] * 4


def test_quality_labels_agree(spark):
    """Clean documents stay, most junk goes."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    counts = {(r["quality"], r["kept"]): r["count"] for r in rules.judged(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts[0, False] > 5 * counts.get((0, True), 0)


@pytest.mark.parametrize("name", ["op11_quality_rules"])
def test_sql_gives_the_same_rows_and_the_plan_has_no_python(spark, name):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    assert check.compare(spark, check.connect(folder), folder, name)[0] is None
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
