"""Layout, structure and sections on small documents."""

import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from quirewise.operators import evaluate
from quirewise.operators import layout as L
from quirewise.operators import sections as X
from quirewise.operators import stats as ST
from quirewise.operators import structure as R
from quirewise.operators import vectors as V
from quirewise.plans import queries, resume

LINE = "doc_id string, line_index int, page int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean"


def lines(spark, rows):
    return spark.createDataFrame(rows, LINE).withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))


def flow(texts, doc="d", **style):
    """One column of lines, 12 points apart; style[i] overrides (size, bold, x0)."""
    out = []
    for i, t in enumerate(texts):
        size, bold, x0 = style.get(f"_{i}", (10.0, False, 40.0))
        out.append((doc, i, 1, t, x0, 40.0 + 12 * i, x0 + 5.0 * len(t), 50.0 + 12 * i, size, bold))
    return out


def test_visual_rows_against_python(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for d in range(20):
        items = sorted(((p, rng.randint(0, 60) / 2, rng.randint(0, 500) / 1.0, i) for i, p in enumerate([1] * 12 + [2] * 8)))
        groups = []
        for p, y, x, i in items:
            base = y + 10
            if groups and groups[-1][0][0] == p and abs(base - statistics.median(b for _, b, _ in groups[-1])) <= 3:
                groups[-1].append((p, base, i))
            else:
                groups.append([(p, base, i)])
            rows.append((str(d), i, p, "t", x, y, x + 20, y + 10, 10.0, False))
        want |= {(str(d), i): g for g, members in enumerate(groups) for *_, i in members}
    df = lines(spark, rows).withColumns({"baseline": F.col("y1"), "tol": F.lit(3.0)})
    assert {(r["doc_id"], r["line_index"]): r["row"] for r in L.visual_rows(df, "tol").collect()} == want


def test_gutter_parts_rows(spark):
    rows = [("d", 0, 1, "a", 0.0, 0.0, 50.0, 10.0, 10.0, False), ("d", 1, 1, "b", 100.0, 0.0, 150.0, 10.0, 10.0, False)]
    df = lines(spark, rows).withColumns({"baseline": F.col("y1"), "tol": F.lit(3.0), "g": F.array(F.struct(F.lit(1).alias("page"), F.lit(60.0).alias("left"), F.lit(90.0).alias("right")))})
    assert len({r["row"] for r in L.visual_rows(df, "tol", "g").collect()}) == 2 and len({r["row"] for r in L.visual_rows(df, "tol").collect()}) == 1


def test_blocks(spark):
    def blocks(texts, gaps):
        y, rows = 0.0, []
        for i, (t, g) in enumerate(zip(texts, gaps)):
            y += g
            rows.append(("d", i, 1, t, 0.0, y, 100.0, y + 10, 10.0, False))
            y += 10
        df = lines(spark, rows).withColumns({"paragraph_gap": F.lit(5.0), "line_height": F.lit(10.0)})
        return [r["lines"] for r in sorted(L.paragraphs(df).collect(), key=lambda r: r["block"])]

    assert blocks(["a", "b", "c"], [0, 2, 14]) == [2, 1]
    assert blocks(["a (open", "b) closed", "c"], [0, 20, 20]) == [2, 1]
    assert blocks(["a (open", "b", "c", "d", "e"], [0, 20, 20, 20, 20]) == [4, 1]
    assert blocks(["a (open", "b"], [0, 40]) == [1, 1]
    assert blocks(["a", "b"], [0, -5]) == [1, 1]


def test_words(spark):
    def words(tokens):
        rows = [("d", 1, 0, s, i, t, x0, 0.0, x1, 10.0, o, f, 10.0, b, 5.0) for i, (t, x0, x1, o, f, b, s) in enumerate(tokens)]
        df = spark.createDataFrame(rows, "doc_id string, page int, line_no int, span_no int, tok_no int, text string, x0 double, y0 double, x1 double, y1 double, origin_y double, font string, size double, bold boolean, char_width double").withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))
        return [r["text"] for r in sorted(L.words(df, F.lit(3.0)).collect(), key=lambda r: r["word"])]

    glyph = lambda t, x, o=8.0, f="A", b=False, s=0, w=5.0: (t, x, x + w, o, f, b, s)
    assert words([glyph("a", 0.0), glyph("b", 4.0), glyph("c", 9.5)]) == ["abc"]
    assert words([glyph("a", 0.0), glyph("b", 8.0)]) == ["a", "b"]
    assert words([glyph("a", 0.0), glyph(" ", 5.0), glyph("b", 10.0)]) == ["a", "b"]
    assert words([glyph("a", 0.0), glyph("2", 5.0, o=3.0)]) == ["a", "2"]
    assert words([glyph("a", 0.0), glyph("b", 5.0, f="B", s=1)]) == ["ab"]
    assert words([glyph("a", 0.0), glyph("b", 6.5, f="B", s=1)]) == ["a", "b"]


def test_furniture_and_numbering(spark):
    rows = [("d", 10 * p + i, p, t, 0.0, y, 100.0, y + 10, 10.0, False) for p in (1, 2, 3) for i, (t, y) in enumerate([(f"Banner {p}", 5.0), (" ", 30.0), (f"body {p}", 200.0), (f"Page {p}", 780.0)])]
    rows.append(("d", 99, 3, "Banner 9", 0.0, 300.0, 100.0, 310.0, 10.0, False))
    df = lines(spark, rows).withColumnRenamed("line_index", "line_no")
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in (1, 2, 3)], "doc_id string, page int, width double, height double")
    got = sorted((r["line_index"], r["text"]) for r in ST.extracted_lines(df, pages).collect())
    assert got == [(0, "body 1"), (1, "body 2"), (2, "body 3"), (3, "Banner 9")]


def test_body_size_counts_characters(spark):
    spans = spark.createDataFrame([("d", 1, 0, 0, "HEAD", 14.0), ("d", 1, 1, 0, "HEAD", 14.0), ("d", 1, 2, 0, "a long body line", 10.04), ("e", 1, 0, 0, "ab", 9.0), ("e", 1, 1, 0, "cd", 8.0)], "doc_id string, page int, line_no int, span_no int, text string, size double")
    assert {r["doc_id"]: r["body_font_size"] for r in ST.body_size(spans).collect()} == {"d": 10.0, "e": 9.0}


def test_gutter(spark):
    two = [("d", i, 1, "x", x, 10.0 + 14 * (i // 2), x + 100, 20.0 + 14 * (i // 2), 10.0, False) for i, x in enumerate([0.0, 150.0] * 6)]
    one = [("e", i, 1, "x", 0.0, 10.0 + 14 * i, 250.0, 20.0 + 14 * i, 10.0, False) for i in range(12)]
    widths = spark.createDataFrame([("d", 5.0), ("e", 5.0)], "doc_id string, median_character_width double")
    got = ST.gutters(lines(spark, two + one), widths).collect()
    assert [(r["doc_id"], r["left"], r["right"], r["left_lines"], r["right_lines"]) for r in got] == [("d", 100.0, 150.0, 6, 6)]


def test_gutters_move_each_line_once(spark):
    rows = [("d", i, 1, "x", x, 10.0 + 14 * (i // 2), x + 100, 20.0 + 14 * (i // 2), 10.0, False) for i, x in enumerate([0.0, 150.0] * 6)]
    df = lines(spark, rows)
    plan = ST.gutters(df, df.select("doc_id").distinct().withColumn("median_character_width", F.lit(5.0)))._jdf.queryExecution().executedPlan().toString()
    # no join of lines with each other, by page
    assert "Join" in plan and not [k for k in plan.splitlines() if "Join" in k and "page" in k]


def test_gutters_against_every_x(spark, monkeypatch):
    """Pages of random columns, against looking at each whole x, with pieces of any size."""
    rng = random.Random(5)
    rows, want = [], []
    for page in range(1, 41):
        boxes = []
        for i in range(rng.choice([4, 8, 14, 30])):
            left = rng.choice([10.0, 130.0, 260.0]) + rng.randrange(8) / 2
            top = 10.0 * rng.randrange(20) + rng.randrange(3) / 2
            boxes.append((left, top, left + rng.choice([60.0, 90.5, 110.0, 300.0 if rng.random() < 0.3 else 80.0]), top + 9.0))
        rows += [("d", i, page, "x", *b, 10.0, False) for i, b in enumerate(boxes)]
        want += [("d", page, *g) for g in _gutters_by_hand(boxes)]
    widths = spark.createDataFrame([("d", 5.0)], "doc_id string, median_character_width double")
    got = ST.gutters(lines(spark, rows), widths).collect()
    assert len(want) > 10 and sorted(tuple(r) for r in got) == sorted(want)
    flat = np.array([r[4:8] for r in rows])
    ends = np.concatenate([[0], np.cumsum([sum(r[2] == p for r in rows) for p in range(1, 41)])])
    whole = ST._gutters_of(ends, *flat.T)
    monkeypatch.setattr(ST, "GUTTER_CELLS", 40)
    pieces = ST._gutters_of(ends, *flat.T)
    assert all(np.array_equal(a, b) for a, b in zip([whole[0], *whole[1]], [pieces[0], *pieces[1]]))


def _gutters_by_hand(boxes):
    lo, hi = min(b[1] for b in boxes), max(b[3] for b in boxes)
    found = []
    if len(boxes) >= 8:
        for x in range(math.ceil(min(b[0] for b in boxes)) + 1, math.floor(max(b[2] for b in boxes))):
            sides = [(b, "l" if b[2] <= x else "r" if b[0] >= x else "c") for b in boxes]
            reach, bands = lo, []
            for b in sorted((b for b, s in sides if s == "c"), key=lambda b: (b[1], b[3])):
                bands.append((reach, b[1]))
                reach = max(reach, b[3])
            tall = []
            for t, u in [*bands, (reach, hi)]:
                at = {k: [b for b, s in sides if s == k and b[3] > t and b[1] < u] for k in "lr"}
                if u - t >= (hi - lo) * 0.5 and min(len(at["l"]), len(at["r"])) >= 4 and min(max(b[3] for b in at[k]) for k in "lr") - max(min(b[1] for b in at[k]) for k in "lr") >= (hi - lo) * 0.5:
                    tall.append((u - t, -t, u, len(at["l"]), len(at["r"])))
            if tall:
                found.append((x, max(tall)))
    runs = []
    for x, band in found:
        if runs and runs[-1][-1][0] == x - 1:
            runs[-1].append((x, band))
        else:
            runs.append([(x, band)])
    for run in runs:
        if run[-1][0] - run[0][0] >= 10:
            _, t, u, nl, nr = max(run, key=lambda r: (r[1][0], -r[0]))[1]
            yield float(run[0][0]), float(run[-1][0]), -t, u, nl, nr


def test_overlaps_move_each_line_once(spark):
    """The first pair of each page, against all pairs, without a join of lines with lines."""
    rng = random.Random(7)
    rows = [("d", i, 1 + i % 5, " " if i % 9 == 0 else "x", x, y, x + 30.0, y + 10.0, 10.0, False) for i, (x, y) in enumerate((rng.randrange(300), rng.randrange(300)) for _ in range(120)) for x, y in [(float(x), float(y))]]
    df = lines(spark, rows).withColumnRenamed("line_index", "line_no")
    found = L.overlapping_text(df)
    share = lambda a, b: max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5])) / 300
    pairs = [(a[2], a[1], b[1], a[4]) for a in rows for b in rows if a[2] == b[2] and a[1] < b[1] and a[3] == b[3] == "x" and share(a, b) >= 0.5]
    want = [min(p for p in pairs if p[0] == page) for page in sorted({p[0] for p in pairs})]
    assert want and sorted((r["page"], r["detail"], r["bbox"]["x0"]) for r in found.collect()) == [(page, f"lines {a} and {b} cover each other", x) for page, a, b, x in want]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_warnings_read_packed_pages(spark, sf_dir):
    """All detectors read one packed table: no detector numbers the boxes again."""
    plan = queries.layout_report(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "lineitem" not in plan


HEADS = "doc_id string, line_index int, section_type string, similarity double, runner_up double"


def test_routing(spark):
    rows = flow(["Jane", "EXPERIENCE", "words", "SAFETY", "more", "EDUCATION", "end"], _1=(14.0, True, 40.0), _3=(14.0, True, 40.0), _5=(14.0, True, 40.0))
    heads = spark.createDataFrame([("d", 1, "experience", 1.0, 0.0), ("d", 5, "education", 1.0, 0.0)], HEADS)
    got = [(r["line_index"], r["section_type"]) for r in sorted(R.routed_headings(lines(spark, rows), heads).collect(), key=lambda r: r["heading_no"])]
    assert got == [(1, "experience"), (3, "others"), (5, "education")]


def test_small_indented_label_is_passed_over(spark):
    rows = flow(["Jane", "SKILLS", "TOOLS", "x"], _1=(14.0, True, 40.0), _2=(10.0, True, 60.0))
    rows.append(("d", 4, 1, "hammer", 300.0, 64.0, 340.0, 74.0, 10.0, False))
    heads = spark.createDataFrame([("d", 1, "skills", 1.0, 0.0), ("d", 2, "tools_equipment", 1.0, 0.0)], HEADS)
    assert [r["section_type"] for r in R.routed_headings(lines(spark, rows), heads).collect()] == ["skills"]


def test_section_names_fold_the_text_once(spark):
    """Each section's branch worked the text out again, and plans grew past what Spark compiles."""
    df = lines(spark, flow(["Work  EXPERIENCE", "Skills and Education", "nothing known"]))
    h = R.heading_components(F.col("text"))
    plan = df.select(R.exact_section(F.col("text")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    got = [[(c["text"], c["section_type"]) for c in r[0]] for r in df.orderBy("line_index").select(h).collect()]
    assert got == [[("Work  EXPERIENCE", "experience")], [("Skills", "skills"), ("Education", "education")], [("nothing known", None)]]
    t = spark.createDataFrame([(None,), ("",), ("&",)], "text string")
    assert [r[0] and [tuple(c) for c in r[0]] for r in t.select(h).collect()] == [None, [("", None)], [("&", None)]]


def test_surest_title_without_a_rank(spark):
    """Of titles as sure as each other the first; one without confidence comes last; one sort a line."""
    kinds = "doc_id string, line_index int, seg int, text string, title boolean, confidence double, org boolean, loc boolean, marker boolean, link boolean"
    rows = [("d", 0, i, "A", t, c, False, False, m, False) for i, (t, c, m) in enumerate([(True, None, False), (True, 0.5, False), (True, 0.5, False), (True, 0.9, True), (False, 0.9, False)])]
    rows.append(("d", 1, 0, "A", True, None, True, False, False, False))
    out = X.reconcile_segments(spark.createDataFrame(rows, kinds))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and plan.count("Sort [") == 1
    got = {(r["line_index"], r["seg"]): r["role"] for r in out.collect()}
    assert got == {(0, 0): "job_title", (0, 1): "job_title", (0, 2): "job_title", (0, 3): "company", (0, 4): "unresolved", (1, 0): "job_title"}


def test_logical_sections(spark):
    rows = [("d", 0, 5, "CERTIFICATIONS & LANGUAGES", "certifications", t, s) for t, s in []]
    full = [("d", 0, i, "CERTIFICATIONS & LANGUAGES", "others", t, s) for i, (t, s) in enumerate([("Thai: Native", False), ("Driving licence", False), ("Certifications", True), ("AWS", False), ("Hobby", True), ("chess", False)])]
    full += [("e", 0, i, "SAFETY & TRAINING", "others", t, False) for i, t in enumerate(["a", "b"])]
    full += [("f", 0, i, "TRAINING & CERTIFICATIONS", "others", t, False) for i, t in enumerate(["a", "b"])] + [("g", 0, 0, "Skills", "skills", "Thai: Native", False)]
    df = spark.createDataFrame(rows + full, "doc_id string, heading_no int, line_index int, heading_text string, section_type string, text string, subheading boolean")
    got = {}
    for r in R.logical_sections(df).collect():
        got.setdefault(r["doc_id"], {})[r["line_index"]] = r["logical_type"]
    assert got["d"] == {0: "languages", 1: "others", 2: "certifications", 3: "certifications", 4: "others", 5: "others"}
    assert set(got["e"].values()) == {"others"} and set(got["f"].values()) == {"certifications"} and got["g"] == {0: "skills"}


def test_experience_records(spark):
    # (bullet, bold, has_range, primary, place)
    kinds = {"M": (False, True, True, True, False), "m": (False, False, False, True, False), "L": (False, False, False, False, True), "B": (True, False, False, False, False), "T": (False, False, False, False, False)}
    rows = [("d", 0, i, *kinds[k]) for i, k in enumerate("MLTBmMBLT")]
    df = spark.createDataFrame(rows, "doc_id string, heading_no int, line_index int, bullet boolean, bold boolean, has_range boolean, primary boolean, place boolean")
    got = [(r["record"], r["role"][0]) for r in sorted(X.experience_roles(df).collect(), key=lambda r: r["line_index"])]
    assert got == [(0, "m"), (0, "m"), (0, "b"), (0, "b"), (0, "b"), (1, "m"), (1, "b"), (1, "b"), (1, "b")]


def test_education_records(spark):
    # (explicit, prose, titles, institutions, dates, other, short)
    kinds = {"T": (True, False, True, False, False, False, True), "I": (True, False, False, True, True, False, True), "g": (True, False, False, False, False, True, True), "p": (False, True, False, False, False, False, False), "s": (False, False, False, False, False, False, True)}
    rows = [("d", 0, i, *kinds[k]) for i, k in enumerate("TsIgpTII")]
    df = spark.createDataFrame(rows, "doc_id string, heading_no int, row int, explicit boolean, prose boolean, titles boolean, institutions boolean, dates boolean, other boolean, short boolean")
    got = [(r["record"], r["role"]) for r in sorted(X.education_roles(df).collect(), key=lambda r: r["row"])]
    assert got == [(0, "metadata"), (0, "title_tail"), (0, "metadata"), (0, "metadata"), (0, "body"), (1, "metadata"), (1, "metadata"), (2, "metadata")]


def test_entities(spark):
    tags = [("B-ORG", 0.9), ("ORG", 0.7), ("O", 0.9), ("I-LOC", 0.6), ("B-LOC", 0.8), ("I-LOC", 0.4)]
    df = spark.createDataFrame([("d", i, t, s, 4 * i, 4 * i + 3) for i, (t, s) in enumerate(tags)], "doc_id string, tok_no int, tag string, score double, start int, end int")
    groups = sorted((r["label"], r["start"], r["end"], round(r["score"], 6)) for r in V.entity_groups(df, ["doc_id"]).collect())
    assert groups == [("LOC", 12, 15, 0.6), ("LOC", 16, 23, 0.6), ("ORG", 0, 7, 0.8)]
    texts = spark.createDataFrame([("d", "abc def ghi jkl mno pqr")], "doc_id string, text string")
    merged = {(r["label"], r["text"], r["score"]) for r in V.merged_entities(V.entity_groups(df, ["doc_id"]), texts, ["doc_id"]).withColumn("score", F.round("score", 6)).collect()}
    assert merged == {("ORG", "abc def", 0.8), ("LOC", "jkl mno pqr", 0.6)}


def test_attribute_labels(spark):
    refs = spark.createDataFrame([("age", "Age", 0), ("gender", "Gender", 1), ("gender", "Sex", 2)], "class string, phrase string, ord int")
    labels = spark.createDataFrame([(1, "AGE"), (2, "genders"), (3, "zzzz")], "k int, label string")
    got = {r["k"]: (r["class"], r["confidence"]) for r in V.attribute_labels(labels, refs, "k", V.hashed_provider()).collect()}
    assert got[1] == ("age", 1.0) and got[2][0] == "gender" and got[2][1] < 1 and 3 not in got


def test_phrase_titles(spark):
    df = lines(spark, flow(["Senior Software Engineer and Engineer", "Engineering"]))
    got = [(r["start"], r["text"]) for r in V.phrase_titles(df, ["Engineer", "Software Engineer"]).collect()]
    assert sorted(got) == [(7, "Software Engineer"), (29, "Engineer")]


def test_partitions_do_not_matter(spark):
    rows = [r for d in range(30) for r in flow(["Jane", "LANGUAGES", "Thai: Native", "HOBBIES", "• chess", "2019 - 2020 club"], doc=str(d), _1=(14.0, True, 40.0), _3=(14.0, True, 40.0))]
    widths = spark.createDataFrame([(str(d), 5.0) for d in range(30)], "doc_id string, median_character_width double")

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return sorted(map(str, resume.resumes(lines(spark, rows).repartition(n), widths).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)

    assert run(1) == run(7)


def test_resume_end_to_end(spark):
    rows = flow(["Jane Roe", "jane@mail.example.com | +66 81 555 2741", "AWARDS", "Best paper", "2019 - 2020", "• top of class", "LANGUAGES", "Thai: Native"], _2=(14.0, True, 40.0), _3=(12.0, True, 40.0), _6=(14.0, True, 40.0))
    widths = spark.createDataFrame([("d", 5.0)], "doc_id string, median_character_width double")
    r = resume.resumes(lines(spark, rows), widths).first()["resume"].asDict(recursive=True)
    assert r["header_profile"]["emails"] == ["jane@mail.example.com"] and r["header_profile"]["phones"] == ["+66 81 555 2741"]
    assert r["awards"] == [{"subheadings": ["Best paper"], "dates": ["2019 - 2020"], "urls": [], "paragraphs": [], "bullets": ["top of class"]}]
    assert r["languages"][0]["paragraphs"] == ["Thai: Native"] and r["skills"] is None and r["schema_version"] == "1.0"
    assert r["header_profile"]["name"] == "Jane Roe"


def test_resume_sections(spark):
    big = (14.0, True, 40.0)
    texts = ["Jane Roe", "SUMMARY", "A short text", "EXPERIENCE", "Analyst @ Acme Ltd | 2019 - 2021", "• did this", "Lead @ Beta Inc | 2021 - Present", "prose here", "EDUCATION", "Bachelor of Science, North University, 2012", "GPA: 3.5/4.0", "SKILLS", "Tools: hammer, saw", "HOBBIES", "INTERESTS", "chess"]
    rows = flow(texts, **{f"_{i}": big for i, t in enumerate(texts) if t.isupper() and t.isalpha()})
    widths = spark.createDataFrame([("d", 5.0)], "doc_id string, median_character_width double")
    r = resume.resumes(lines(spark, rows), widths).first()["resume"].asDict(recursive=True)
    assert r["summary"] == {"content": [{"type": "paragraph", "text": "A short text"}]}
    assert [(e["job_titles"], e["companies"], e["dates"], e["bullets"], e["paragraphs"]) for e in r["experience"]] == [(["Analyst"], ["Acme Ltd |"], ["2019 - 2021"], ["did this"], []), (["Lead"], ["Beta Inc |"], ["2021 - Present"], [], ["prose here"])]
    assert [(e["titles"], e["institutions"], e["dates"], e["gpa"]) for e in r["education"]] == [(["Bachelor of Science, North University"], ["Bachelor of Science, North University"], ["2012"], ["GPA: 3.5/4.0"])]
    assert r["skills"] == [{"subheading": "Tools", "paragraphs": ["hammer, saw"], "bullets": [], "urls": []}]
    assert r["interests"] is not None and r["awards"] is None


def test_scorecard(spark):
    label = '{"header_profile": {"name": "Ann Lee", "emails": ["a@b.cc"], "urls": ["https://x.y/z"]}, "sections_present": ["experience", "skills"], "experience": [{"job_titles": ["Analyst"], "dates": ["2019 - 2020"]}, {"companies": ["Big Corp"]}]}'
    result = '{"header_profile": {"name": "ann  LEE", "emails": ["a@b.cc", "q@b.cc"], "urls": [{"text": "x", "url": "https://x.y/z"}], "age": null}, "skills": [], "experience": [{"job_titles": ["Senior Analyst"], "companies": [], "dates": ["2019 – 2020"], "locations": ["Rome"]}], "education": null}'
    rows = lambda *x: spark.createDataFrame(list(x), "doc_id string, json string")
    got = {r["field"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.scorecard(rows(("1", label), ("2", None)), rows(("1", result), ("3", result))).collect()}
    assert got == {
        "header.name": (1, 0, 0), "header.emails": (1, 1, 0), "header.urls": (1, 0, 0), "section_routing": (1, 0, 1), "experience.job_titles": (1, 0, 0),
        "experience.companies": (0, 0, 1), "experience.dates": (1, 0, 0), "experience.locations": (0, 1, 0), "experience.entry_count": (1, 0, 1),
    }


def test_class_scores_in_blocks(spark, monkeypatch):
    cand = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "k int, vector array<float>")
    refs = spark.createDataFrame([(f"c{i % 4}", i, [0.1 * i, 1.0 - 0.05 * i]) for i in range(20)], "class string, ord int, vector array<float>")
    rows = lambda: sorted(map(tuple, V.class_scores(cand, refs, ["k"]).select("k", "class", "ord", "score").collect()))
    few = rows()
    monkeypatch.setattr(V, "REFERENCE_ROWS", 5)
    monkeypatch.setattr(V, "REFERENCE_BLOCK", 3)
    assert rows() == few and len(few) == 36
