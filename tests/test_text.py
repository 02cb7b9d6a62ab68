import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineaudit.functions import responses as A
from lineaudit.functions import status as ST
from lineaudit.functions import text as T


def one(spark, values, fn, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


TRICKY = ["", "\n", "a", "a\n", "a\n\nb", "\r\r", "a\r\nb", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b", "a b c",
          " lead\n\ttab ", "x\n\n", "\n\n"]


def test_splitlines_matches_python(spark):
    assert one(spark, TRICKY, T.splitlines) == [s.splitlines() for s in TRICKY]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab/ \t\n\r\x0b\x85\xa0 　{}*", max_size=12), min_size=5, max_size=20))
def test_strip_and_lines_random(spark, texts):
    assert one(spark, texts, T.strip) == [s.strip() for s in texts]
    assert one(spark, texts, T.splitlines) == [s.splitlines() for s in texts]
    assert one(spark, texts, T.squeeze_hash) == [hashlib.sha1("".join(s.split()).encode()).hexdigest() for s in texts]


def test_scorable_lines(spark):
    no = ["", "   ", "\t", "// c", "    // c", "/// d", "/* b", "* x", "*/"]
    yes = ["let x = 0;", "    invariant i <= n,", "}", "    }", "{"]
    assert one(spark, no, T.is_scorable) == [False] * len(no)
    assert one(spark, yes, T.is_scorable) == [True] * len(yes)
    assert one(spark, ["}", "{}", ") x", "let", "// a", "// a // FAILS"], T.is_scorable_strict) == [
        False, False, False, True, False, True]


def test_sentinels_and_label_space(spark):
    text = "let x = 0;\n\n// a comment\nlet y = 1;\n"
    assert one(spark, [text], lambda t: T.scorable_line_indices(T.splitlines(t))) == [[0, 3]]
    assert one(spark, [text], lambda t: T.insert_sentinels(T.splitlines(t), "S"))[0].count("S") == 2
    impl = "let a = 1;\n\nlet b = 2;\nlet c = 3;\n"
    got = one(spark, [impl], lambda t: T.to_sentinel_space(
        F.array(F.lit(2), F.lit(1), F.lit(2)), T.scorable_line_indices(T.splitlines(t))))
    assert got == [[1]]


SNIPPET = """use lib;
fn main() {
}
fn compute_sum(n: u64) -> (r: u64)
    requires n < 100,
    ensures r == n,
{
    let mut result = 0;
    while i < n
        invariant i <= n,
    {
        i = i + 1;
    }
}"""


def test_spec_impl(spark):
    spec, impl = one(spark, [SNIPPET], T.spec_impl)[0]
    assert spec.startswith("fn compute_sum") and "ensures" in spec and spec.endswith("{")
    assert impl.startswith("    let mut result") and "invariant" in impl
    assert tuple(one(spark, ["a\nb {\nc"], T.spec_impl)[0]) == ("a\nb {", "c")
    assert tuple(one(spark, ["a\nb"], T.spec_impl)[0]) == ("a\nb", "")
    assert tuple(one(spark, ["fn f()\n  x"], T.spec_impl)[0]) == ("fn f()\n  x", "")
    assert tuple(one(spark, ["use a;\nfn g() {\nx\n}"], T.heuristic_spec_impl)[0]) == ("use a;", "fn g() {\nx\n}")


def test_markers(spark):
    assert one(spark, ["a  // FAILS", "b ", "// FAILS"], lambda t: T.strip_fails(F.array(t))[0]) == ["a", "b ", ""]
    rx = re.compile(r"\s*//\s*(?:FAILS?|FIXME|TODO|BUG|XXX|HACK|broken|wrong|ok|verified|passes)\b.*?$", re.I | re.M)
    texts = ["a // FAILS x\nb", "a\n   // todo\nb", "a // okay", "x // ok", "a //BUG\n\n// wrong y"]
    assert one(spark, texts, T.strip_markers) == [rx.sub("", t) for t in texts]
    assert one(spark, ["a", "a // b "], lambda t: T.inject_marker(t, F.lit("// X"))) == ["a  // X", "a // b // X"]


def test_answers(spark):
    c = ['{"top_lines": [3, 1, 1, 9, 0]}', 'so {"top_lines": [2, -1, 4]} ok', "4 then 2, 2 and 1", '{"x": 1}', "[1, 2]", ""]
    assert one(spark, c, lambda t: A.ranked_lines(t, F.lit(5))) == [[3, 1, 0], [2, 4], [4, 2, 1], [], [1, 2], []]
    v = ['{"verdict": " PASS ", "p_fail": 1.7}', '{"verdict": "x", "p_fail": "0.3"}', 'a "verdict": "Fail" b', "p", '"p_fail": 0.25']
    got = [(r["verdict"], r["p_fail"]) for r in one(spark, v, A.verdict)]
    assert got == [("pass", 1.0), (None, None), ("fail", None), (None, None), (None, 0.25)]


def test_verifier_output_and_code(spark):
    outs = ["verification results:: 3 verified, 1 errors", "error: a\nx error: b\nerror: c", "fine"]
    assert [tuple(r) for r in one(spark, outs, T.verifier_counts)] == [(3, 1), (0, 2), (0, 0)]
    answers = ["t\n```rust\nlet a;\n```", "```", "  plain ", "```\nverus!{ x } // e\n```", "", "```rust\nfn main() {}\n```"]
    assert one(spark, answers, T.response_code) == ["let a;", None, "plain", "x", None, None]


def test_jaccard(spark):
    df = spark.createDataFrame([("", ""), ("", "a"), ("a", "a"), ("abc", "abd"), ("é😀x", "é😀y")], "a string, b string")
    got = [round(r[0], 6) for r in df.coalesce(1).select(T.char_jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 1.0, round(1 / 3, 6), round(1 / 3, 6)]


@pytest.mark.parametrize("raw,expected", [
    ("Status.PASS", ("PASS", "PASS", "PASS", "PASS", "UNKNOWN")),
    ("err_ok", ("ERR_OK", "FAIL", "PASS", "PASS", "UNKNOWN")),
    ("failed", ("FAILED", "FAIL", "FAIL", "UNKNOWN", "UNKNOWN")),
    ("timeout", ("TIMEOUT", "UNKNOWN", "UNKNOWN", "UNKNOWN", "FAIL")),
])
def test_status_dialects(spark, raw, expected):
    row = spark.createDataFrame([(raw,)], "t string").select(*[
        f(F.col("t")) for f in (ST.verbatim, ST.fail_first, ST.pass_first, ST.by_suffix, ST.trajectory)]).first()
    assert tuple(row) == expected
