"""Column functions on stated cases."""

import re

import pytest
from pyspark.sql import functions as F

from quirewise.functions import geometry as G
from quirewise.functions import patterns as P
from quirewise.functions import separators as S
from quirewise.functions import text as T
from quirewise.functions.spans import complement, find_all, without_overlaps
from quirewise.operators import claims as C
from quirewise.operators import evaluate as E
from quirewise.plans import output


def each(spark, values, f, *more):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", f(F.col("t")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def test_bullets(spark):
    marks = ["•", "●", "▪", "◦", "‣", "", "¢", "-", "+", "*", "1.", "2)", "10."]
    assert all(each(spark, [f"{m} item" for m in marks], lambda t: t.rlike(P.BULLET)))
    assert each(spark, ["•​﻿ item", "plain words", "-5", "3.5"], lambda t: t.rlike(P.BULLET)) == [True, False, True, True]
    assert each(spark, ["•​﻿ item", "- x", "plain"], T.without_marker) == ["item", "x", "plain"]


def test_dates(spark):
    ranges = ["2019 - 2022", "Jan 2020 – Present", "From 2018 - Current", "January 2019 to March 2021", "Feb-2020 — Now", "2019-2020", "Sep 2020 - Oct 2021", "may 2019 – 2020"]
    assert all(len(x) == 1 for x in each(spark, ranges, lambda t: find_all(t, P.DATE_RANGE)))
    assert [[m["text"] for m in x] for x in each(spark, ["1999 and 2024 but not 3021", "2018 - 2020, 2023"], C.date_spans)] == [["1999", "2024"], ["2018 - 2020", "2023"]]
    assert each(spark, ["2019", "Jan 2020", "Present", "since 2019", ""], P.is_date) == [True, True, True, False, False]


def test_contacts(spark):
    line = "jane.doe@mail.example.com | +66 81 555 2741 | (02) 555-2741 | linkedin.com/in/jane"
    found = lambda p: [m["text"] for m in each(spark, [line], lambda t: find_all(t, p))[0]]
    assert found(P.EMAIL) == ["jane.doe@mail.example.com"] and found(P.PHONE) == ["+66 81 555 2741", "02) 555-2741"] and found(P.URL) == ["linkedin.com/in/jane"]
    assert each(spark, ["+66 81 XXX XXXX", "x12345678y"], lambda t: F.size(find_all(t, P.PHONE))) == [0, 0]


def test_gpa_location_language(spark):
    assert each(spark, ["GPA: 3.75/4.0", "grade point average 88 out of 100"], lambda t: F.array(*[F.regexp_extract(t, P.GPA, n) for n in (2, 3)])) == [["3.75", "4.0"], ["88", "100"]]
    assert each(spark, ["Bangkok, Thailand", "12 Road, Town", "a@b, c", "nowhere"], lambda t: t.rlike(P.LOCATION)) == [True, False, False, False]
    assert each(spark, ["Thai", "chinese (Mandarin)", "English words", "Klingon"], P.is_language) == [True, True, False, False]


def test_labels(spark):
    labels = ["Date  of Birth", "DOB", "Martial Status", "Visa type", "Citizenship", "Annual Package", "Salary", "Home"]
    assert each(spark, labels, T.attribute_kind) == ["date_of_birth", "date_of_birth", "marital_status", "visa_status", "nationality", "current_package", "current_income", "current_residence"]


def test_invisibles(spark):
    assert each(spark, ["a​﻿‌‍­b"], T.without_invisibles) == ["ab"]
    assert each(spark, ["​ \t\n", "", "x", "­"], T.is_blank) == [True, True, False, True]
    assert each(spark, ["​ x ﻿", "a‌b"], T.clean) == ["x", "a‌b"]


def test_headings(spark):
    assert each(spark, ["01 EXPERIENCE", "2. Education", "IV — Skills", "2024 Highlights", "7", "​Summary"], T.heading_text) == ["EXPERIENCE", "Education", "Skills", "2024 Highlights", "7", "Summary"]
    assert each(spark, ["Page 3  of 12", "page 10 of 12 "], T.furniture_key) == ["Page # of #", "page # of #"]


def test_brackets(spark):
    assert each(spark, ["(a [b", "a) (b", "(a)", "", "((a)"], T.bracket_depth) == [2, 1, 0, 0, 1]
    assert each(spark, ["Institution (", ") - x", "C++ (graphics)", "a ([ ,", "(cont. from"], T.trim_brackets) == ["Institution", "x", "C++ (graphics)", "a", "(cont. from"]


def test_colon(spark):
    labels = ["Languages", "Forklift Safety Awareness (non-licensed", "12", "http", "www.x", "one two three four five six seven eight", ""]
    assert each(spark, labels, S.colon_is_key) == [True, False, False, False, False, False, False]
    assert each(spark, labels[5:6], lambda t: S.colon_is_key(t, 2)) == [True]


def test_splits(spark):
    s = each(spark, ["Senior Engineer @ Acme", "a (b @ c) @ d", " @ x", "none"], S.at_split)
    assert [(x["left"], x["right"], x["right_start"]) if x else None for x in s] == [("Senior Engineer", "Acme", 18), ("a (b @ c)", "d", 12), None, None]
    d = each(spark, ["Analyst - Logistics", "2019 - 2022", "Jan 2019 – Present"], S.dash_split)
    assert [x and (x["left"], x["right"]) for x in d] == [("Analyst", "Logistics"), None, None]


def test_splits_are_reversible(spark):
    texts = ["  Lead @  Acme Co ", "x - y - z", "é @ ü"]
    for f in (S.at_split, S.dash_split):
        for text, s in zip(texts, each(spark, texts, f)):
            if s:
                assert text[s["left_start"] : s["left_end"]] == s["left"] and text[s["right_start"] : s["right_end"]] == s["right"]


def test_metadata_segments(spark):
    assert each(spark, ["Acme | Bangkok – Lead", "Institution (Aug-2024 - 2026)", "a - b"], C.metadata_segments) == [["Acme", "Bangkok", "Lead"], ["Institution"], ["a", "b"]]


def test_compound(spark):
    from quirewise.operators.structure import heading_components

    texts = ["CERTIFICATIONS & LANGUAGES", "Education and Training", "Languages, Tools", "Awards plus Hobbies", "Android", "Safety / Training", "Skills as well as Projects"]
    got = [[(p["text"], p["section_type"]) for p in x] for x in each(spark, texts, heading_components)]
    assert got[0] == [("CERTIFICATIONS", "certifications"), ("LANGUAGES", "languages")] and got[1] == [("Education and Training", "education")]
    assert got[3] == [("Awards", "awards"), ("Hobbies", "interests")] and got[4] == [("Android", None)] and got[5] == [("Safety", None), ("Training", None)] and len(got[6]) == 2


def test_stages(spark):
    assert each(spark, ["1-3,5", "2", "3-1", "x", "4, 4"], T.stages) == [[1, 2, 3, 5], [2], None, None, [4]]


def test_sizes_and_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.135,)], "x double")
    assert [r[0] for r in df.select(T.rounded(F.col("x"))).collect()][0] == 0.12
    sizes = spark.createDataFrame([(5,), (1500,), (2_400_000,), (3_100_000_000,)], "n long").select(T.human_size(F.col("n"))).collect()
    assert [r[0] for r in sizes] == ["5 B", "2 kB", "2 MB", "3.1 GB"]


def test_spans_against_python(spark):
    texts = ["a1b22c333", "", "none", "1", "é1ü22", "12", "x12y"]
    got = each(spark, texts, lambda t: find_all(t, r"\d+"))
    assert [[(m["start"], m["end"], m["text"]) for m in x] for x in got] == [[(*m.span(), m[0]) for m in re.finditer(r"\d+", t)] for t in texts]


def test_interval_algebra(spark):
    df = spark.createDataFrame([([(2, 4), (6, 8)], [(0, 3), (3, 6), (9, 9)])], "c array<struct<start:int,end:int>>, m array<struct<start:int,end:int>>")
    r = df.select(without_overlaps(F.col("c"), F.col("m")).alias("w"), complement(F.col("c"), F.lit(10)).alias("x")).first()
    assert [tuple(s) for s in r["w"]] == [(6, 8)] and [tuple(s) for s in r["x"]] == [(0, 2), (4, 6), (8, 10)]


def test_claims_precedence(spark):
    rows = [("d", 0, "a", 0, 5, "x", 2, 1, "m"), ("d", 0, "b", 4, 8, "y", 1, 9, "m"), ("d", 0, "c", 8, 9, "z", 2, 2, "m"), ("d", 0, "d", 8, 10, "w", 2, 1, "m"), ("d", 1, "e", 0, 5, "v", 6, 1, "m")]
    df = spark.createDataFrame(rows, "doc_id string, line_index int, kind string, start int, end int, text string, tier int, seq int, method string")
    assert sorted(r["kind"] for r in C.resolve(df).collect()) == ["b", "d", "e"]


def test_email_is_no_domain(spark):
    lines = spark.createDataFrame([("d", 0, "Date of Birth: 12 May 1990 | jane@mail.example.com | www.example.com/x")], "doc_id string, line_index int, text string")
    got = {(r["kind"], r["text"]) for r in C.header_claims(lines).collect()}
    assert got == {("date_of_birth", "12 May 1990"), ("email", "jane@mail.example.com"), ("url", "www.example.com/x")}
    other = C.other_claims(lines, C.header_claims(lines)).collect()
    assert not other


def test_tiers(spark):
    assert each(spark, ["regex", "geometry_ner_reconstruction", "job_title_phrase", "minilm_reconciled", "regex_context_fallback"], C.tier_of) == [1, 5, 6, 4, 2]
    assert each(spark, ["geometry_semantic", "date_regex", "distilbert_ner"], C.model_backed) == [True, False, True]


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 20.0, 8.0))], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(G.vertical_overlap(a, b), G.horizontal_overlap(a, b), G.overlap_ratio(a, b), G.span_box(a, F.lit(2), F.lit(4), F.lit(8))["x1"], G.span_box(a, F.lit(4), F.lit(2), F.lit(8))).first()
    assert tuple(r) == (3.0, 5.0, 15 / 45, 5.0, None)


@pytest.mark.parametrize("want,got,counts", [(["thai"], ["thai citizen"], (0, 1, 1)), (["bangkok city"], ["bangkok"], (0, 1, 1)), (["senior analyst"], ["analyst"], (1, 0, 0)), (["a", "a"], ["a"], (1, 0, 1)), ([], ["x"], (0, 1, 0)), (["x"], [], (0, 0, 1))])
def test_matching(spark, want, got, counts):
    if want == ["bangkok city"]:
        counts = (1, 0, 0)
    df = spark.createDataFrame([(want, got)], "w array<string>, g array<string>")
    assert tuple(df.select(E.match_counts(F.col("w"), F.col("g")).alias("c")).first()["c"]) == counts


def test_scores(spark):
    df = spark.createDataFrame([("a", 3, 1, 0), ("a", 1, 0, 1), ("b", 0, 0, 0)], "f string, tp int, fp int, fn int")
    s = {r["f"]: r for r in E.scores(df, ["f"]).collect()}
    assert [s["a"][m] for m in ("precision", "recall", "f1")] == pytest.approx([0.8] * 3) and s["b"]["f1"] == 1.0
    floor = spark.createDataFrame([("a", 0.81), ("b", 1.0), ("c", 0.1)], "field string, f1 double")
    low = E.regressions(E.scores(df, ["f"]).withColumnRenamed("f", "field"), floor).collect()
    assert sorted(r["field"] for r in low) == ["a", "c"]


def test_normal(spark):
    assert each(spark, ["  Straße–Ｘ  y. ", "​A—B·"], E.normal) == ["strasse-x y", "a-b"]


def test_wrap(spark):
    assert each(spark, ["aa bb cc dddddd e"], lambda t: output.wrap(t, 5)) == [["aa bb", "cc", "dddddd", "e"]]


def test_json_states(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    part = spark.createDataFrame([("a", [])], f"doc_id string, skills array<struct<subheading:string,paragraphs:array<string>,bullets:array<string>,urls:array<struct<text:string,url:string>>>>")
    r = {x["doc_id"]: x["j"] for x in output.resumes(docs, [part]).select("doc_id", output.as_json(F.col("resume")).alias("j")).collect()}
    assert '"skills":[]' in r["a"] and '"skills":null' in r["b"] and r["b"].startswith('{"schema_version":"1.0","header_profile":null')
    pretty = each(spark, [r["a"]], output.pretty)[0]
    assert pretty.startswith('{\n  "schema_version": "1.0",\n') and pretty.endswith("}\n")
    assert each(spark, [r["a"], '{"schema_version":"1.0"}', "x"], output.conforms) == [True, False, False]
