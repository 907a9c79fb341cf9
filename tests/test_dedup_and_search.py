"""Duplicate admission against the sequential rule, and search plans that must agree."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.operators import dedup as D
from anamnesis.operators.search import Pattern, regex_problem
from anamnesis.operators.filters import MetaFilter
from anamnesis.plans.search import search


def sequential(batch, threshold):
    """Accept each row in order unless an accepted earlier one is near."""
    kept, out = [], {}
    for m, order, v in sorted(batch, key=lambda r: r[1]):
        near = [k for k in kept if any(v) and any(k[2])
                and round(1 - np.dot(v, k[2]) / (math.sqrt(np.dot(v, v)) * math.sqrt(np.dot(k[2], k[2]))), 6) < threshold]
        out[m] = not near
        if not near:
            kept.append((m, order, v))
    return out


def chained_batch():
    """Points along an arc, each near only its neighbours, with copies, zeros and noise."""
    rng = np.random.default_rng(5)
    arc = [[math.cos(i * 0.25), math.sin(i * 0.25), 0.0] for i in range(20)]
    noise = [list(map(float, rng.normal(size=3))) for _ in range(40)]
    copies = [arc[3]] * 15 + [[0.0, 0.0, 0.0]] * 3
    rows = arc + noise + copies
    order = rng.permutation(len(rows))
    return [(f"m{i:03d}", int(order[i]), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("blocks", [False, True])
def test_admission_follows_the_sequential_rule(spark, monkeypatch, blocks):
    batch = chained_batch()
    if blocks:
        monkeypatch.setattr(D, "fits_broadcast", lambda *a, **k: False)
        monkeypatch.setattr(D, "QUERY_BLOCK_BYTES", 1000)
        monkeypatch.setattr(D, "CORPUS_BLOCK_BYTES", 1000)
    df = spark.createDataFrame(batch, "memory_id string, input_order bigint, vector array<float>")
    got = {r["memory_id"]: r["accepted"] for r in D.admit_in_order(df).collect()}
    assert got == sequential(batch, 0.08)


def test_stored_rows_reject_before_the_batch(spark):
    schema = "memory_id string, input_order bigint, vector array<float>"
    batch = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [0.99, 0.2]), ("c", 3, [0.0, 1.0])], schema)
    stored = spark.createDataFrame([("s", 0, [1.0, -0.05])], "memory_id string, chunk_index int, vector array<float>")
    got = {r["memory_id"]: (r["accepted"], r["similar_id"]) for r in D.near_duplicate_join(batch, stored).collect()}
    # `a` is near the stored row. `b` is near `a` and also near the stored row within 0.08.
    assert got["a"] == (False, "s") and got["c"] == (True, None) and got["b"][0] is False


TEXTS = [("m1", "The cat sat. THE END", 3), ("m2", "a theme (with) parens \\d+ 1999", 2), ("m3", "nothing\nmuch, then", 1), ("m4", "", 0)]
PARITY = ["the", "END", "theme (with)", "zzz", "t", "\\d+", "much, then"]


@pytest.fixture(scope="module")
def memories(spark):
    return spark.createDataFrame(TEXTS, "memory_id string, text string, age int").withColumn(
        "updated_at", F.timestamp_seconds(F.col("age"))).withColumn("tags", F.array(F.concat(F.lit("t"), F.col("age").cast("string"))))


def requests(spark, patterns):
    return spark.createDataFrame([(f"p{i}", *p) if isinstance(p, tuple) else (f"p{i}", p, False, True, 5) for i, p in enumerate(patterns)],
                                 "pattern_id string, pattern string, regex boolean, ignore_case boolean, context_chars int")


@pytest.mark.parametrize("ignore_case", [True, False])
def test_trigram_plan_equals_scan(spark, memories, rows, ignore_case):
    asked = requests(spark, [(p, False, ignore_case, 5) for p in PARITY] + [("th.", True, ignore_case, 5)])
    scan, trigram = (search(asked, memories, searcher=s) for s in ("scan", "trigram"))
    assert rows(scan[0]) == rows(trigram[0])
    assert rows(scan[1]) == rows(trigram[1])


def test_search_statuses_and_snippets(spark, memories):
    asked = requests(spark, ["", "at", "the", "zzz", ("(a+)+", True, True, 5), ("[", True, True, 5), (r"\d{4}", True, True, 5)])
    summary, snippets = search(asked, memories)
    got = {r["pattern_id"]: (r["status"], r["total_matches"], r["total_memories"]) for r in summary.collect()}
    assert got == {"p0": ("empty-query", 0, 0), "p1": ("short-query", 0, 0), "p2": ("ok", 4, 3), "p3": ("no-matches", 0, 0),
                   "p4": ("ok", 4, 2), "p5": ("bad-regex", 0, 0), "p6": ("ok", 1, 1)}
    the = [(r["memory_id"], r["before"], r["match"], r["after"]) for r in snippets.where("pattern_id = 'p2'").orderBy("position").collect()]
    assert the == [("m1", "", "The", " cat "), ("m1", "sat. ", "THE", " END"), ("m2", "a ", "the", "me (w"), ("m3", "uch, ", "the", "n")]
    none = search(asked, memories, MetaFilter(tags=("nope",)))[0].where("pattern_id = 'p2'").first()["status"]
    assert none == "no-candidates"
    assert search(asked, memories, searcher="none")[0].where("pattern_id = 'p2'").first()["status"] == "no-matches"


def test_snippet_caps(spark):
    many = spark.range(300).select(F.format_string("m%04d", "id").alias("memory_id"), F.lit("foo foo foo foo").alias("text"),
                                   F.timestamp_seconds("id").alias("updated_at"), F.array().cast("array<string>").alias("tags"))
    summary, snippets = search(requests(spark, ["foo"]), many)
    assert tuple(summary.select("total_matches", "total_memories").first()) == (1200, 300)
    got = snippets.collect()
    assert len(got) == 200 and max(r["memory_id"] for r in got) == "m0299" and min(r["memory_id"] for r in got) == "m0233"
    assert max(snippets.groupBy("memory_id").count().collect(), key=lambda r: r["count"])["count"] == 3


@pytest.mark.parametrize("pattern,refused", [
    ("(?=a)b", True), (r"(a)\1", True), ("a++", True), ("[", True), ("(a+)+", False), ("(a|b+)*c", False), ("((ab)*)*", False),
    ("(a{2,})+", False), ("(ab)+", False), ("[(+]+", False), (r"\(a+\)+", False), ("a{2,3}b*", False), ("(a?b)+", False),
    (r"C\++", False), ("[*+/]", False)])
def test_regex_refusals(pattern, refused):
    assert bool(regex_problem(Pattern("p", pattern, True))) is refused


def test_expressions_take_linear_time(spark):
    long = spark.createDataFrame([("m", "ab" * 50_000 + "c"), ("n", "a" * 100_000)], "memory_id string, text string").withColumn(
        "updated_at", F.timestamp_seconds(F.lit(1))).withColumn("tags", F.array().cast("array<string>"))
    summary, snippets = search(requests(spark, [("(a|b)*c", True, True, 5), ("(a+)+d", True, True, 5), ("(a|aa)+$", True, True, 5)]), long)
    assert {r["pattern_id"]: (r["status"], r["total_matches"]) for r in summary.collect()} == {
        "p0": ("ok", 1), "p1": ("no-matches", 0), "p2": ("ok", 1)}
    assert {(r["pattern_id"], r["memory_id"], r["start"]) for r in snippets.collect()} == {("p0", "m", 0), ("p2", "n", 0)}
