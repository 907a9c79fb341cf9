"""Column functions against plain statements of their rules."""

from __future__ import annotations

import datetime as dt
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anamnesis.functions import text as T
from anamnesis.functions.chunking import chunk_text, split_long
from anamnesis.functions.ids import is_valid_id, to_uuid
from anamnesis.functions import linear_regex, many_literals
from anamnesis.functions.linear_regex import match_counts, ranges
from anamnesis.functions.many_literals import fold
from anamnesis.functions.matching import literal_count, match_ranges, quote_literal, snippet
from anamnesis.functions.times import end_of_day, from_epoch_ms, from_iso, parse_chat_timestamp
from anamnesis.functions.vectors import cosine_distance

FAST = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, data, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in df.select(column(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


def cut_long(text, limit):
    out = []
    while len(text) > limit:
        at = text.rfind(" ", 0, limit + 1)
        at = at if at > 0 else limit
        out.append(text[:at].strip())
        text = text[at:].strip()
    return out + ([text] if text else [])


def chunks_by_rule(text, limit):
    """One pass over the sentences with an open chunk."""
    if len(text) <= limit:
        return [text] if text.strip() else []
    parts = [s for p in re.split(r"\n{2,}", text) if p.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z\"'])", p.strip())]
    out, open_ = [], ""
    for s in parts:
        if len(s) > limit:
            out += [open_] if open_ else []
            out, open_ = out + cut_long(s, limit), ""
        elif open_ and len(open_) + 1 + len(s) > limit:
            out, open_ = out + [open_], s
        else:
            open_ = f"{open_} {s}" if open_ else s
    return [c.strip() for c in out + [open_] if c.strip()]


word = st.text(alphabet="abAB.!?'\" \n", min_size=1, max_size=12)


@FAST
@given(st.lists(st.lists(word, max_size=30).map("".join), min_size=20, max_size=40))
def test_chunking_follows_the_loop(spark, texts):
    assert values(spark, texts, lambda c: chunk_text(c, 20)) == [chunks_by_rule(t, 20) for t in texts]


@FAST
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=90).map(str.strip).filter(bool), min_size=20, max_size=40))
def test_long_sentences_follow_the_loop(spark, texts):
    assert values(spark, texts, lambda c: split_long(c, 10)) == [cut_long(t, 10) for t in texts]


@FAST
@given(st.lists(st.text(alphabet="aAbé.*", max_size=30), min_size=20, max_size=40), st.text(alphabet="aAb.*", min_size=1, max_size=3))
def test_literal_matches(spark, texts, needle):
    def by_find(text):
        out, at = [], text.find(needle)
        while at >= 0:
            out.append((at, len(needle)))
            at = text.find(needle, at + len(needle))
        return out

    got = values(spark, texts, lambda c: match_ranges(c, F.lit(quote_literal(needle))))
    assert [[tuple(r) for r in x] for x in got] == [by_find(t) for t in texts]
    assert values(spark, texts, lambda c: literal_count(c, F.lit(needle))) == [len(by_find(t)) for t in texts]


def starts(text, pattern, fold=False, limit=None):
    return [(r["start"], r["length"]) for r in ranges(text, pattern, fold, limit)]


@pytest.mark.parametrize("pattern", ["[ab]+", "é|a", "^a", "a.?b", "(a)(b)?"])
def test_regex_matches_and_limits(pattern):
    for text in ["", "baa", "aab aab", "éaé", "bbb\na", chr(0xFDD0) + "ab"]:
        want = [(m.start(), m.end() - m.start()) for m in re.finditer(pattern, text)]
        assert starts(text, pattern) == want and starts(text, pattern, limit=1) == want[:1]
    assert ranges(None, pattern, False) is None


@pytest.mark.parametrize("pattern", ["^v[0-9]", r"\bfoo", "(?m)^a", "a|^b", "x*", "$", r"\b", "(a)|(b)$", "é+|^", "[ab]"])
@pytest.mark.parametrize("fold", [False, True])
def test_regex_counts_are_the_number_of_ranges(pattern, fold):
    texts = ["v1v2v3", "foofoo foo", "aa\na", "abb", "", "axxb", "ééa ÉÉ", chr(0xFDD0) + "b", "A B\nab"]
    counts = match_counts(pa.array(texts), pattern, fold).to_pylist()
    assert counts == [len(ranges(t, pattern, fold)) for t in texts]
    assert [match_counts(pa.array([t]), p, False)[0].as_py() for t, p in (("v1v2v3", "^v[0-9]"), ("foofoo", r"\bfoo"), ("aa\na", "(?m)^a"),
                                                                         ("abb", "a|^b"))] == [1, 1, 2, 1]


def test_equal_expressions_are_matched_once(monkeypatch):
    texts = pa.array(["foo food", None, "", "xfoo", "foo" + chr(0xFDD0)])
    asked = [("a", "foo[a-z]*", False), ("b", "foo[a-z]*", False), ("c", r"\bfoo", False), ("d", "FOO", True), ("e", "FOO", False)]
    calls = []
    monkeypatch.setattr(linear_regex.pc, "match_substring_regex", lambda *a, real=pc.match_substring_regex, **k: calls.append(a) or real(*a, **k))
    for restricted in (False, True):
        ids, wanted = pa.array(list("01234")), pa.array([["a", "c"], ["a"], None, ["b"], ["b", "d", "x"]])
        batch = pa.RecordBatch.from_arrays([ids, ids, texts, wanted][:3 + restricted], ["m", "u", "t", "p"][:3 + restricted])
        calls.clear()
        made = [(r["pattern_id"], int(r["memory_id"]), r["matches"]) for out in linear_regex.hits_of(asked, restricted)(iter([batch]))
                for r in out.to_pylist()]
        want = [(p, i, len(ranges(t, e, f))) for p, e, f in asked for i, t in enumerate(texts.to_pylist())
                if t and (not restricted or p in (wanted[i].as_py() or ()))]
        assert sorted(made) == sorted(w for w in want if w[2])
        assert len([c for c in calls if len(c[0]) == len(texts) and c[1] == "foo[a-z]*"]) == 1


@pytest.mark.parametrize("size", [1, 4])
def test_marks_are_counted_in_slices_with_nulls(size):
    texts = pa.array(["aa b", None, "﶐ a﷏", "", "a\u4e00a", None, "aaa"]).slice(size)
    assert match_counts(texts, r"\ba", False).to_pylist() == [None if t is None else len(ranges(t, r"\ba", False)) for t in texts.to_pylist()]


def test_many_literals_in_one_walk():
    texts = ["The cat, the THE", None, "", "aaaa", "éthe É", "abcabcab"]
    asked = [("a", "the", True), ("b", "THE", False), ("c", "aa", True), ("d", "abcab", True), ("e", "É", True), ("f", "the", True),
             ("g", "é", True), ("h", "bca", False)]
    want = {(p, i, n) for p, literal, folded in asked for i, t in enumerate(texts) if t
            for n in [(fold(t).count(fold(literal)) if folded else t.count(literal))] if n}
    ids = pa.array([str(i) for i in range(len(texts))])
    for restricted in (False, True):
        columns = [ids, ids, pa.array(texts)] + ([pa.array([[a[0] for a in asked] + ["other"]] * len(texts))] if restricted else [])
        batch = pa.RecordBatch.from_arrays(columns, ["m", "u", "t", "p"][:len(columns)])
        made = [r for out in many_literals.hits_of(asked, restricted)(iter([batch])) for r in out.to_pylist()]
        assert {(r["pattern_id"], int(r["memory_id"]), r["matches"]) for r in made} == want and len(made) == len(want)


def test_regex_case_and_dot():
    assert len(starts("ÉTÉ été", "été", True)) == 2
    assert (len(starts("a\nb", "a.b")), len(starts("a b", "a.b"))) == (0, 1)


def test_dollar_is_the_end_of_the_text():
    def counts(pattern):
        return [len(starts(t, pattern)) for t in ("a\n", "a", "a$\na")]

    assert counts("a$") == [0, 1, 1] and counts("(?m)a$") == [1, 1, 1] and counts(r"a\$") == [0, 0, 1] and counts("a[$]") == [0, 0, 1]


def test_snippet_is_clipped(spark):
    got = values(spark, ["0123456789"], lambda c: snippet(c, F.lit(2), F.lit(3), F.lit(4)))
    assert tuple(got[0]) == ("01", "234", "5678")


def test_tokens_and_counts(spark):
    assert values(spark, ["The the  a B2-b2 É_été", "", "!"], T.tokenize) == [["the", "the", "b2", "b2", "été"], [], []]
    got = values(spark, ["b b aa aa aa cc", ""], lambda c: T.term_counts(T.tokenize(F.concat(c, c))))
    assert [[tuple(r) for r in x] for x in got][1] == []
    counted = values(spark, ["xx yy xx zz xx yy"], lambda c: T.term_counts(T.tokenize(c)))
    assert [tuple(r) for r in counted[0]] == [("xx", 3), ("yy", 2), ("zz", 1)]


def test_trigrams(spark):
    assert values(spark, ["ABCab", "ab", "", "é\U0001F600aé"], T.trigrams) == [
        ["abc", "bca", "cab"], [], [], ["é\U0001F600a", "\U0001F600aé"]]


def test_ascii_lower_keeps_length(spark):
    assert values(spark, ["İÉABC"], T.ascii_lower) == ["İÉabc"]


def test_chat_times(spark):
    cases = [("13/2/24", "9:05", "2024-02-13 09:05:00"), ("2/13/2024", "9:05:07 PM", "2024-02-13 21:05:07"),
             ("3.4.24", "12:00 am", "2024-04-03 00:00:00"), ("3-4-2024", "12:30 PM", "2024-04-03 12:30:00"),
             ("31/02/24", "00:00", "2024-03-02 00:00:00"), ("1/0/24", "25:61", "2023-12-02 02:01:00"),
             ("20/20/24", "10:00", "2025-08-20 10:00:00")]
    df = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(cases)], "i int, d string, t string")
    got = [r[0] for r in df.orderBy("i").select(parse_chat_timestamp(F.col("d"), F.col("t"))).collect()]
    assert got == [dt.datetime.fromisoformat(w) for _, _, w in cases]


def test_odd_times_are_null(spark):
    assert values(spark, [0.0, -1.0, float("nan"), float("inf"), 1500.9], from_epoch_ms, "double")[:4] == [None] * 4
    assert values(spark, [1500.9], from_epoch_ms, "double") == [dt.datetime(1970, 1, 1, 0, 0, 1, 500000)]
    assert values(spark, ["", "soon", "2024-01-02T03:04:05+01:00"], from_iso) == [None, None, dt.datetime(2024, 1, 2, 2, 4, 5)]
    assert values(spark, ["2024-01-02", "2024-01-02T00:00:00Z"], end_of_day) == [
        "2024-01-02T23:59:59.999Z", "2024-01-02T00:00:00Z"]


def test_ids(spark):
    good = values(spark, ["seed", None], to_uuid)
    assert good[1] is None and re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", good[0])
    assert values(spark, [good[0], good[0].upper(), "../x", None, good[0] + "\n"], is_valid_id) == [True, False, False, False, False]


def test_rendering(spark):
    assert [tuple(x) for x in values(spark, ["abc", "x" * 201], T.preview)] == [("abc", False), ("x" * 200 + "…", True)]
    assert values(spark, ["a \n\t b c"], T.collapse_whitespace) == ["a b c"]
    assert values(spark, ["<http://a|b> <https://c> <!here> "], T.clean_markup) == ["b https://c <!here>"]


def test_zero_vector_is_far_from_everything(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])],
                               "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(cosine_distance("a", "b")).collect()] == [1.0, 1.0, 0.0]
