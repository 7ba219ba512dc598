from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import bands, corpus, features, parsing, prompts
from gradeframe.functions import text as t


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s string").select(fn(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("given, expected", [
    ("Rs. 5,500 crore!", "rs. 5 500 crore"), ("75% — été", "75% été"), (None, ""), ("", ""), ("  A\u00a0\tB  ", "a b"),
])
def test_normalise(spark, given, expected):
    assert one(spark, given, t.normalise) == expected


@pytest.mark.parametrize("given, expected", [("rs. 5 500 crore", ["5", "500"]), ("within 30.", ["30."]), ("none", []), ("7 7 12.5", ["12.5", "7"])])
def test_number_set(spark, given, expected):
    assert one(spark, given, t.number_set) == expected


def test_number_set_trims_dots_on_request(spark):
    assert one(spark, "within 30.", lambda c: t.number_set(c, trim_dots=True)) == ["30"]


def test_number_set_lenient(spark):
    assert one(spark, "₹5,500 and 30.", t.number_set_lenient) == ["30", "5500"]


@pytest.mark.parametrize("given, own, fixed", [("Yes, because", "yes", "yes"), ("Not so", "no", "no"), ("maybe", "maybe", "unclear")])
def test_yn_label(spark, given, own, fixed):
    assert one(spark, given, lambda c: t.yn_label(t.normalise(c))) == own
    assert one(spark, given, lambda c: t.yn_label(t.normalise(c), "unclear")) == fixed


def test_yn_label_word_boundary(spark):
    assert one(spark, "notified", lambda c: t.yn_label(c, "other", word_boundary=True)) == "other"


@pytest.mark.parametrize("gold, pred, f1", [("a b b c", "b b d", 4 / 7), ("a", "", 0.0), ("a b", "c d", 0.0), ("x y", "y x", 1.0)])
def test_token_f1(spark, gold, pred, f1):
    got = spark.createDataFrame([(gold, pred)], "g string, p string").select(t.token_f1("g", "p")).first()[0]
    assert got == pytest.approx(f1)


@pytest.mark.parametrize("given, expected", [
    ("32.35%. Calculation: a/b", "32.35%"), ("0.50 crore rupees (2.5%)", "0.5 crore"), ("1 October 2025 (warrant)", "1 10 2025"),
    ("₹19,000 crore", "19000 crore"), ("by 29 Jul", "29 07"),
])
def test_canonical_answer(spark, given, expected):
    assert one(spark, given, t.canonical_answer) == expected


def test_strip_think(spark):
    assert one(spark, "<think>x\ny</think> 5", t.strip_think) == "5"
    assert one(spark, "<think>x</think>", t.strip_think).startswith("FAIL")


@pytest.mark.parametrize("given, expected", [("steps\nANSWER: 30 days\nend", "30 days"), ("first\n\nlast line \n", "last line"), ("answer: 7", "7")])
def test_extract_cot_answer(spark, given, expected):
    assert one(spark, given, t.extract_cot_answer) == expected


def test_extract_answer(spark):
    assert one(spark, "The answer is: 42", lambda c: t.extract_answer(c, F.lit("numerical_reasoning"))) == ": 42"
    assert one(spark, "Answer : 42", lambda c: t.extract_answer(c, F.lit("x"))) == "42"
    assert one(spark, "Yes it does.\nMore", lambda c: t.extract_answer(c, F.lit("contradiction_detection"))) == "Yes it does."


def test_clean_text(spark):
    raw = "Page 2 of 10\n  “Quoted” – text\x07\n12\nab\n\n\nkept line\u200b"
    assert one(spark, raw, corpus.clean_text) == '"Quoted" - text\nkept line'


@pytest.mark.parametrize("name, year", [("SRC_2018_x.txt", 2018), ("a12019b", None), ("none", None), ("1999_2005", 1999)])
def test_year_from_name(spark, name, year):
    assert one(spark, name, corpus.year_from_name) == year


@pytest.mark.parametrize("year, era", [(1999, "Pre-2000"), (2000, "2000-2015"), (2015, "2000-2015"), (2016, "Post-2015"), (None, None), (2101, None)])
def test_era(spark, year, era):
    got = spark.createDataFrame([(year,)], "y int").select(bands.era_bucket("y")).first()[0]
    assert got == era


def test_first_pdf_link(spark):
    link = lambda c: corpus.first_pdf_link(c, "https://s.example")
    assert one(spark, "<a href='/x.html'>a</a><a class=k href=\" d/A.PDF \">b</a>", link) == "https://s.example/d/A.PDF"
    assert one(spark, "<p>see http://o.example/f.pdf now</p>", link) == "http://o.example/f.pdf"
    assert one(spark, "<embed href='/q/z.pdf'>", link) == "https://s.example/q/z.pdf"
    assert one(spark, "nothing", link) is None


def test_listing_rows(spark):
    html = (
        "<table><tr><td>1 Jan</td><td><a href='/a'>Circular on <b>funds</b></a></td></tr>"
        "<tr><td>2 Jan</td><td><a href='/b'>Next page of list</a></td></tr>"
        "<tr><td>only one cell <a href='/c'>Long enough title</a></td></tr>"
        "<tr><td>3 Jan</td><td><a href='http://o/d.pdf'>short</a></td></tr>"
        "<tr><td>4 Jan</td><td><a href='x/e.pdf'>Another circular</a></td></tr></table>"
    )
    got = corpus.listing_rows(spark.createDataFrame([(html,)], "html string"), base="https://s").collect()
    assert [(r["title"], r["date"], r["detail_url"]) for r in got] == [
        ("Circular on funds", "1 Jan", "https://s/a"), ("Another circular", "4 Jan", "https://s/x/e.pdf"),
    ]


def test_perturbations(spark):
    assert one(spark, "in 1985, 1990, 2025 and 2029", features.perturb_years) == "in 1985, 1995, 2030 and 2029"
    assert one(spark, "1,234.55 Crore and 2.45 crore or 2.55crore", features.perturb_crore) == "12346 million and 24 million or 26 million"
    assert one(spark, "Hereby amended with effect from May", features.perturb_synonyms) == "as a result modified effective May"
    assert one(spark, "no match", features.perturb_years) == "no match"


def test_judge_scores(spark):
    good = 'x {"event_identification": {"score": "1"}, "temporal_ordering": {"score": 0, "reason": "r"}} y'
    assert one(spark, good, parsing.judge_scores).asDict() == {"event_score": 1, "ordering_score": 0, "final_score": 0}
    for bad in ("no json", "{broken", '{"event_identification": {"score": "high"}}'):
        assert one(spark, bad, parsing.judge_scores) is None


def test_verdict_keyword_order(spark):
    assert one(spark, "clearly INCORRECT", parsing.parse_verdict)["verdict"] == "INCORRECT"
    assert one(spark, "CORRECT | a | b", parsing.parse_verdict).asDict() == {"verdict": "CORRECT", "reason": "a | b"}


def test_rater_label(spark):
    assert one(spark, " Y ", parsing.rater_label) == 1
    assert one(spark, "maybe", parsing.rater_label) is None
    with pytest.raises(Exception, match="not a rater label"):
        one(spark, "maybe", lambda c: parsing.rater_label(c, strict=True))


def test_build_prompt_styles(spark):
    df = spark.createDataFrame([("contradiction_detection", "", "a b", "c d", "Q?"), ("numerical_reasoning", "w1  w2", None, None, "N?")],
                               "task_type string, context string, context_a string, context_b string, question string")
    got = [r["prompt"] for r in prompts.build_prompt(df).collect()]
    assert got[0] == "Passage A:\na b\n\nPassage B:\nc d\n\nQuestion: Q?\n\nAnswer with 'Yes' or 'No' then one sentence of explanation:"
    assert got[1] == "Context:\nw1 w2\n\nQuestion: N?\n\nShow your calculation and give the final answer with units:"
    assert prompts.build_prompt(df, "hosted").collect()[1]["prompt"].startswith("CONTEXT:\nw1  w2\n\nQUESTION: N?")
