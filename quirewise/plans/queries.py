"""Queries of the document operators over the driver's tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import separators as S
from ..functions import text as T
from ..functions.spans import find_all
from ..operators import claims as C
from ..operators import evaluate as E
from ..operators import header as H
from ..operators import layout as L
from ..operators import sections as X
from ..operators import stats as ST
from ..operators import structure as R
from ..operators import vectors as V
from ..sources import corpus, images, ocr, physical
from . import output, resume
from .stage import staged
from .synthetic import frame, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "text"))


def _lines(spark, sf_dir):
    return frame(spark, sf_dir, "lines").withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))


def _boxes(spark, sf_dir):
    return frame(spark, sf_dir, "boxes").withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))


def _pages(boxes):
    return boxes.groupBy("doc_id", "page").agg(F.lit(612.0).alias("width"), (F.max("y1") + 20).alias("height"), F.lit(False).alias("used_ocr"))


def _widths(df):
    return df.select("doc_id").distinct().withColumn("median_character_width", F.lit(5.0))


DOC_LINES = "dl AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_index, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x)"
LINES = f"lines AS (SELECT * FROM ({sql('lines')}) q)"
BOXES = f"boxes AS (SELECT * FROM ({sql('boxes')}) q), pages AS (SELECT doc_id, page, max(y1) + 20 AS height FROM boxes GROUP BY ALL)"
GLYPHS = f"glyphs AS (SELECT * FROM ({sql('glyphs')}) q)"
CLAIMS = f"claims AS (SELECT * FROM ({sql('claims')}) q)"
HORIZONTAL = "abs(dir_x) > abs(dir_y)"
ALNUM = "length(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))".format
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))".format


# -- text ---------------------------------------------------------------


@query(f"""WITH {DOC_LINES} SELECT doc_id, line_index, trim(text) AS cleaned, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\d+', '#', 'g')) AS furniture_key,
  CAST({ALNUM('text')} AS INT) AS letters, CAST({WORDS('text')} AS INT) AS words FROM dl WHERE trim(text) <> ''""")
def clean_lines(spark, sf_dir):
    t = F.col("text")
    return _doc_lines(spark, sf_dir).where(~T.is_blank(t)).select("doc_id", "line_index", T.clean(t).alias("cleaned"), T.furniture_key(t).alias("furniture_key"), T.meaningful(t).alias("letters"), T.word_count(t).alias("words"))


@query(f"WITH {LINES} SELECT doc_id, line_index, coalesce(nullif(regexp_replace(text, '^\\s*(?:\\d{{1,2}}|[IVXivx]{{1,4}})\\s*[.)\\]:–—-]?\\s+', ''), ''), text) AS heading, round(CASE WHEN regexp_matches(text, '[A-Za-z]') THEN length(regexp_replace(text, '[^A-Z]', '', 'g')) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) ELSE 0 END, 6) AS capitals FROM lines")
def heading_texts(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_index", T.heading_text(F.col("text")).alias("heading"), F.round(T.upper_ratio(F.col("text")), 6).alias("capitals"))


@query("""WITH k AS (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Date  of Birth' WHEN 1 THEN 'AGE' WHEN 2 THEN 'Sex' WHEN 3 THEN 'martial status' WHEN 4 THEN 'Work Visa' WHEN 5 THEN 'Citizenship' WHEN 6 THEN 'Current CTC' WHEN 7 THEN 'last drawn salary' ELSE c_name END AS label FROM customer)
SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'date_of_birth' WHEN 1 THEN 'age' WHEN 2 THEN 'gender' WHEN 3 THEN 'marital_status' WHEN 4 THEN 'visa_status' WHEN 5 THEN 'nationality' WHEN 6 THEN 'current_package' WHEN 7 THEN 'current_income' ELSE 'current_residence' END AS kind FROM k""")
def attribute_kinds(spark, sf_dir):
    labels = spark.sql("SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Date  of Birth' WHEN 1 THEN 'AGE' WHEN 2 THEN 'Sex' WHEN 3 THEN 'martial status' WHEN 4 THEN 'Work Visa' WHEN 5 THEN 'Citizenship' WHEN 6 THEN 'Current CTC' WHEN 7 THEN 'last drawn salary' ELSE c_name END AS label FROM {c}", c=_table(spark, sf_dir, "customer"))
    return labels.select("c_custkey", T.attribute_kind(F.col("label")).alias("kind"))


@query(f"""WITH {LINES}, c AS (SELECT doc_id, line_index, generate_subscripts(x, 1) AS i, unnest(x) AS ch FROM (SELECT doc_id, line_index, string_split(text, '') AS x FROM lines) y),
 d AS (SELECT doc_id, line_index, i, sum(CASE WHEN ch IN ('(', '[') THEN 1 WHEN ch IN (')', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, line_index ORDER BY i) AS s FROM c)
 SELECT doc_id, line_index, CAST(arg_max(s, i) - least(0, min(s)) AS INT) AS depth FROM d GROUP BY ALL""")
def bracket_depths(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_index", T.bracket_depth(F.col("text")).alias("depth"))


@query(f"""WITH {LINES} SELECT doc_id, line_index, trim(CASE WHEN part LIKE '(%' OR part LIKE '%)' THEN part ELSE part END, ' ,;:-') AS trimmed FROM (SELECT doc_id, line_index, regexp_replace(split_part(text, '(', 2), '^\\)+', '') AS part FROM lines WHERE text LIKE '%(%') x""")
def trimmed_brackets(spark, sf_dir):
    """What stands behind an opening bracket, its own orphans dropped."""
    part = F.element_at(F.split("text", r"\("), 2)
    some = _lines(spark, sf_dir).where(F.col("text").contains("("))
    return some.select("doc_id", "line_index", T.trim_brackets(part).alias("trimmed"))


@query("""SELECT o_orderkey, round_even(o_totalprice / 7, 2) AS seventh, CASE WHEN o_orderkey < 1000 THEN CAST(o_orderkey AS STRING) || ' B' WHEN o_orderkey * 977 < 1000000 THEN CAST(CAST(round_even(o_orderkey * 977 / 1000, 0) AS BIGINT) AS STRING) || ' kB' ELSE CAST(CAST(round_even(o_orderkey * 977 / 1000000, 0) AS BIGINT) AS STRING) || ' MB' END AS size FROM orders""")
def rounded_sizes(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    n = F.when(F.col("o_orderkey") < 1000, F.col("o_orderkey")).otherwise(F.greatest(F.col("o_orderkey") * 977, F.lit(1000)))
    return o.select("o_orderkey", T.rounded(F.col("o_totalprice") / 7).alias("seventh"), T.human_size(n).alias("size"))


@query("""WITH p AS (SELECT c_custkey, 1 + c_custkey % 5 AS a, 1 + c_custkey // 5 % 5 AS b, 1 + c_custkey // 25 % 5 AS c FROM customer)
SELECT c_custkey, CASE WHEN a <= b THEN list_aggregate(list_sort(list_distinct(list_concat(range(a, b + 1), [c]))), 'string_agg', ',') END AS stages FROM p""")
def parsed_stages(spark, sf_dir):
    k = F.col("c_custkey")
    part = lambda d: (1 + F.floor(k / d) % 5).cast("string")
    spec = F.concat(part(1), F.lit("-"), part(5), F.lit(", "), part(25))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(T.stages(spec), lambda x: x.cast("string")), ",").alias("stages"))


@query(f"""WITH {LINES} SELECT doc_id, line_index, rtrim(regexp_replace(text, '[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}', repeat(' ', length(regexp_extract(text, '[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}'))))) AS masked FROM lines""")
def masked_contacts(spark, sf_dir):
    t = F.col("text")
    return _lines(spark, sf_dir).select("doc_id", "line_index", F.rtrim(T.mask(t, find_all(t, P.EMAIL))).alias("masked"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_index, text, CAST(instr(text, '|') AS INT) AS bar FROM lines) SELECT doc_id, line_index, trim(part, ' |,;:•·-–—()') AS label, CAST(bar + length(part) - length(ltrim(part, ' |,;:•·-–—()')) AS INT) AS start, CAST(bar + length(part) - length(ltrim(part, ' |,;:•·-–—()')) + length(trim(part, ' |,;:•·-–—()')) AS INT) AS stop FROM (SELECT *, substr(text, bar + 1) AS part FROM p) x""")
def trimmed_labels(spark, sf_dir):
    """What stands behind a line's first bar, or all of it, without separators at its ends."""
    at = F.instr("text", "|")
    span = _lines(spark, sf_dir).select("doc_id", "line_index", T.trimmed_label(F.substring(F.col("text"), at + 1, F.length("text")), at).alias("s"))
    return span.select("doc_id", "line_index", F.col("s.text").alias("label"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(f"""WITH {LINES} SELECT doc_id, line_index, trim(regexp_replace(text, '^\\s*(?:[-+*•●▪◦‣¢]|\\d+[.)])\\s*', '')) AS bare FROM lines""")
def bullets_without_markers(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_index", T.without_marker(F.col("text")).alias("bare"))


@query("""SELECT c_custkey, array_to_string(list_filter([c_name, CASE WHEN c_custkey % 3 = 0 THEN '  ' END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END], lambda v: v IS NOT NULL AND trim(v) <> ''), ' · ') AS joined FROM customer""")
def joined_values(spark, sf_dir):
    k = F.col("c_custkey")
    values = F.array("c_name", F.when(k % 3 == 0, "  "), F.when(k % 2 == 0, F.col("c_mktsegment")))
    return _table(spark, sf_dir, "customer").select("c_custkey", T.joined(values).alias("joined"))


@query(f"""WITH {LINES} SELECT doc_id, line_index, regexp_matches(trim(text), '(?i)^((Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\\s+)?(19|20)\\d{{2}}$') AS is_date FROM (SELECT doc_id, line_index, CASE WHEN text LIKE 'Jan%' THEN split_part(text, ' – ', 1) ELSE text END AS text FROM lines) x""")
def date_ends(spark, sf_dir):
    """Whether a line, or what stands before its dash, is one end of a date range."""
    t = F.when(F.col("text").startswith("Jan"), F.split_part("text", F.lit(" – "), F.lit(1))).otherwise(F.col("text"))
    return _lines(spark, sf_dir).select("doc_id", "line_index", P.is_date(t).alias("is_date"))


_LABELS = "regexp_extract(text, '^([A-Za-z][A-Za-z .''/]{{1,40}}?)\\s*(?::|[-–—])\\s*(.+)$', {0})".format


@query(f"""WITH {LINES} SELECT doc_id, line_index, {_LABELS(1)} AS label, {_LABELS(2)} AS body FROM lines WHERE regexp_matches(text, '^([A-Za-z][A-Za-z .''/]{{1,40}}?)\\s*(?::|[-–—])\\s*(.+)$')""")
def inline_labels(spark, sf_dir):
    """Lines that are a label and its value, whatever the label is."""
    t = F.col("text")
    return _lines(spark, sf_dir).where(P.matches(t, P.INLINE)).select("doc_id", "line_index", P.group(t, P.INLINE, 1).alias("label"), P.group(t, P.INLINE, 2).alias("body"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_index, CAST(unnest(range(len(p))) AS INT) AS part, unnest(p) AS text FROM (SELECT doc_id, line_index, list_transform(string_split(text, ' | '), lambda x: trim(x)) AS p FROM lines) x) SELECT doc_id, line_index, part, {_LABELS(1)} AS label, {_LABELS(2)} AS body FROM s WHERE regexp_matches(text, '^([A-Za-z][A-Za-z .''/]{{1,40}}?)\\s*(?::|[-–—])\\s*(.+)$')""")
def generic_labels(spark, sf_dir):
    """Label and value in each part between bars."""
    parts = _lines(spark, sf_dir).select("doc_id", "line_index", F.posexplode(F.split("text", r" \| ")).alias("part", "text")).withColumn("text", F.trim("text"))
    t = F.col("text")
    own = parts.where(P.matches(t, rf"^{P.GENERIC}$"))
    return own.select("doc_id", "line_index", "part", P.group(t, rf"^{P.GENERIC}$", 1).alias("label"), P.group(t, rf"^{P.GENERIC}$", 2).alias("body"))


@query(f"""WITH {BOXES}, s AS (SELECT doc_id, median((x1 - x0) / length(text)) AS char, median(y1 - y0) AS height, median((x1 - x0) / 10) AS space FROM boxes GROUP BY doc_id)
 SELECT doc_id, round(CASE WHEN space > 0 THEN space * 0.6 ELSE char * 0.3 END, 6) AS word_gap, round(greatest(space, char) * 5.0, 6) AS cell_gap, round(height * 0.5, 6) AS tolerance, round(greatest(1.5 * 2.0, height * 0.5), 6) AS paragraph_gap FROM s""")
def gap_thresholds(spark, sf_dir):
    """Gaps of documents from their characters, spaces and line heights."""
    b = _boxes(spark, sf_dir)
    s = b.groupBy("doc_id").agg(F.median((F.col("x1") - F.col("x0")) / F.length("text")).alias("char"), F.median(F.col("y1") - F.col("y0")).alias("height"), F.median((F.col("x1") - F.col("x0")) / 10).alias("space"))
    t = ST.thresholds(F.col("space"), F.col("char"), F.col("height"), F.lit(1.5), F.lit(10.0))
    return s.select("doc_id", *[F.round(t[k], 6).alias(n) for k, n in (("word_gap", "word_gap"), ("cell_gap", "cell_gap"), ("baseline_tolerance", "tolerance"), ("paragraph_gap", "paragraph_gap"))])


# -- patterns -------------------------------------------------------------

_FLAGS = {
    "bullet": (P.BULLET, "^\\s*(?:[-+*•●▪◦‣¢]|\\d+[.)])"),
    "email": (P.EMAIL, "[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{2,}"),
    "phone": (P.PHONE, "(?:^|[^\\p{L}\\p{N}_])\\+?\\d[\\d ()\\-.]{6,}\\d(?:$|[^\\p{L}\\p{N}_])"),
    "web": (P.URL, "(?i)https?://[^\\s|,;)]+|@mail\\.example"),
    "date_range": (P.DATE_RANGE, "(?i)\\b(?:19|20)\\d{2}\\s*[-–]\\s*(?:(?:19|20)\\d{2}|present|current|now)\\b"),
    "year": (P.YEAR, "\\b(?:19|20)\\d{2}\\b"),
    "degree": (P.DEGREE, "(?i)\\b(?:bachelor|associate|degree|diploma|certificate|graduate)\\b"),
    "institution": (P.INSTITUTION, "(?i)\\b(?:university|college|institute|school|academy)\\b"),
    "gpa": (P.GPA, "(?i)\\bgpa\\s*:?[\\s-]*\\d"),
    "footer": (P.PAGE_FOOTER, "(?i)\\bpage\\s+\\d+\\s*$"),
    "company": (P.COMPANY, "(?i)\\b(?:company|ltd|limited|inc|llc)\\b"),
    "labelled": (P.LABELLED, "(?i)\\b(?:date\\s+of\\s+birth|nationality)\\b\\s*:"),
    "location": (P.LOCATION, "^[^\\d@]{2,48},\\s*[^\\d@]{2,48}$"),
    "at_sign": (P.AT, "\\s+@\\s+"),
    "metadata": (P.METADATA_SEPARATOR, "[|•·–—]|\\s-\\s"),
    "key_value": (P.KEY_COLON, "^[^:\\t]{1,60}:\\s*.+$"),
    "compound": (P.COMPOUND, "(?i)\\b(?:and|with|plus|along\\s+with|as\\s+well\\s+as)\\b|[&+/|,;]"),
}


# the address of a mail is no web address, and a phone is looked for outside words only
@query(f"WITH {LINES} SELECT doc_id, line_index, " + ", ".join(f"regexp_matches(text, '{b if n != 'web' else '(?i)https?://[^ |,;)]+'}') AS {n}" for n, (_, b) in _FLAGS.items()) + " FROM lines")
def pattern_flags(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_index", *[P.matches(F.col("text"), p).alias(n) for n, (p, _) in _FLAGS.items()])


@query("SELECT page_id, regexp_extract(url, '(?i)https?://[^\\s|,;)]+') AS found, CAST(0 AS INT) AS start, CAST(length(regexp_extract(url, '(?i)https?://[^\\s|,;)]+')) AS INT) AS stop FROM pages")
def page_urls(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.explode(find_all(F.col("url"), P.URL)).alias("m"))
    return p.select("page_id", F.col("m.text").alias("found"), F.col("m.start").alias("start"), F.col("m.end").alias("stop"))


@query(f"""WITH {DOC_LINES}, m AS (SELECT doc_id, line_index, text, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_.-]+\\.[A-Za-z]{{2,}}')) AS found FROM dl)
SELECT doc_id, line_index, found, CAST(instr(text, found) - 1 AS INT) AS start, CAST(instr(text, found) - 1 + length(found) AS INT) AS stop FROM m""")
def document_emails(spark, sf_dir):
    c = C.pattern_claims(_doc_lines(spark, sf_dir), P.EMAIL, "email")
    return c.select("doc_id", "line_index", F.col("text").alias("found"), "start", F.col("end").alias("stop"))


@query(f"""WITH {LINES}, r AS (SELECT doc_id, line_index, text, regexp_extract_all(text, '(?i)\\b(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+)?(?:19|20)\\d{{2}}\\s*[-–]\\s*(?:(?:19|20)\\d{{2}}|Present|Current|Now)\\b') AS ranges FROM lines),
 y AS (SELECT doc_id, line_index, ranges, regexp_extract_all(CASE WHEN len(ranges) > 0 THEN replace(text, ranges[1], '') ELSE text END, '\\b(?:19|20)\\d{{2}}\\b') AS years FROM r)
 SELECT doc_id, line_index, list_aggregate(list_concat(ranges, years), 'string_agg', '; ') AS dates FROM y WHERE len(ranges) + len(years) > 0""")
def line_dates(spark, sf_dir):
    d = _lines(spark, sf_dir).withColumn("d", C.date_spans(F.col("text"))).where(F.size("d") > 0)
    return d.select("doc_id", "line_index", F.array_join(F.transform("d", lambda m: m["text"]), "; ").alias("dates"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_index, regexp_replace(regexp_replace(text, '(?i)\\b(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+)?(?:19|20)\\d{{2}}\\s*[-–]\\s*(?:(?:19|20)\\d{{2}}|Present|Current|Now)\\b', '|', 'g'), '\\b(?:19|20)\\d{{2}}\\b', '|', 'g') AS t FROM lines),
 p AS (SELECT doc_id, line_index, list_filter(list_transform(regexp_split_to_array(t, '\\s*(?:[|•·]|–|—|\\s-\\s)\\s*'), lambda x: trim(x, ' ,;:-–—()[]')), lambda x: x <> '') AS parts FROM s)
 SELECT doc_id, line_index, len(parts) AS n, list_aggregate(parts, 'string_agg', ' / ') AS segments FROM p WHERE len(parts) > 0""")
def metadata_lines(spark, sf_dir):
    s = _lines(spark, sf_dir).withColumn("p", C.metadata_segments(F.col("text"))).where(F.size("p") > 0)
    return s.select("doc_id", "line_index", F.size("p").cast("long").alias("n"), F.array_join("p", " / ").alias("segments"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, line_index, text, trim(regexp_extract(text, '^([^:\\t]{{1,60}}):\\s*(.+)$', 1)) AS label, trim(regexp_extract(text, '^([^:\\t]{{1,60}}):\\s*(.+)$', 2)) AS body, trim(regexp_extract(text, '^(.{{1,60}}?)\\s+(?:-|–|—)\\s+(.+)$', 1)) AS l2, trim(regexp_extract(text, '^(.{{1,60}}?)\\s+(?:-|–|—)\\s+(.+)$', 2)) AS b2 FROM lines)
 SELECT doc_id, line_index, CASE WHEN label <> '' AND lower(label) NOT LIKE 'http%' THEN label ELSE l2 END AS label, CASE WHEN label <> '' AND lower(label) NOT LIKE 'http%' THEN body ELSE b2 END AS body, CASE WHEN label <> '' AND lower(label) NOT LIKE 'http%' THEN 'colon' ELSE 'dash' END AS method
 FROM k WHERE (label <> '' AND lower(label) NOT LIKE 'http%') OR (l2 <> '' AND NOT (regexp_matches(l2, '(?i)^((Jan|Feb|Mar)\\s+)?(19|20)\\d{{2}}$') AND regexp_matches(b2, '(?i)^((19|20)\\d{{2}}|present)$')))""")
def key_values(spark, sf_dir):
    k = _lines(spark, sf_dir).withColumn("k", S.key_value(F.col("text"))).where("k is not null")
    return k.select("doc_id", "line_index", "k.label", "k.body", "k.method")


@query(f"""WITH {LINES} SELECT doc_id, line_index, trim(split_part(t, ' @ ', 1)) AS role, trim(regexp_replace(split_part(t, ' @ ', 2), '\\s+$', '')) AS employer, CAST(instr(t, ' @ ') + 2 AS INT) AS at FROM (SELECT doc_id, line_index, regexp_replace(text, '((?:19|20)\\d{{2}}) - ((?:19|20)\\d{{2}})', '           ') AS t FROM lines WHERE text LIKE '% @ %') x""")
def at_signs(spark, sf_dir):
    t = F.col("text")
    s = _lines(spark, sf_dir).withColumn("s", S.at_split(T.mask(t, find_all(t, P.DATE_RANGE)))).where("s is not null")
    return s.select("doc_id", "line_index", F.col("s.left").alias("role"), F.col("s.right").alias("employer"), F.col("s.right_start").alias("at"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_index, list_filter(list_transform(regexp_split_to_array(text, '(?i)\\s*(?:\\bas\\s+well\\s+as\\b|\\balong\\s+with\\b|\\band\\b|\\bwith\\b|\\bplus\\b|[&+/|,;])\\s*'), lambda x: trim(x)), lambda x: length(x) >= 2 AND regexp_matches(x, '[A-Za-z]')) AS parts FROM lines WHERE lower(text) NOT IN ('work experience', 'education'))
 SELECT doc_id, line_index, CAST(unnest(range(len(parts))) AS INT) AS n, unnest(parts) AS part, CASE WHEN lower(unnest(parts)) = 'certifications' THEN 'certifications' WHEN lower(unnest(parts)) = 'languages' THEN 'languages' END AS section_type FROM p WHERE len(parts) > 1""")
def compound_parts(spark, sf_dir):
    c = _lines(spark, sf_dir).withColumn("c", R.heading_components(F.col("text"))).where(F.size("c") > 1)
    return c.select("doc_id", "line_index", F.posexplode("c").alias("n", "p")).select("doc_id", "line_index", "n", F.col("p.text").alias("part"), "p.section_type")


# -- claims ---------------------------------------------------------------


@query(f"""WITH {CLAIMS} SELECT doc_id, line_index, seq, kind FROM claims c WHERE tier > 2 AND NOT EXISTS (SELECT 1 FROM claims m WHERE m.tier <= 2 AND m.doc_id = c.doc_id AND m.line_index = c.line_index AND c.start < m."end" AND m.start < c."end")""")
def unclaimed_spans(spark, sf_dir):
    c = frame(spark, sf_dir, "claims")
    return C.unclaimed(c.where("tier > 2"), c.where("tier <= 2")).select("doc_id", "line_index", "seq", "kind")


@query(f"""WITH RECURSIVE {CLAIMS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_index ORDER BY tier, seq) AS n FROM claims),
 f AS (SELECT doc_id, line_index, n, [struct_pack(s := start, e := "end")] AS taken, seq, tier, kind, true AS ok FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.line_index, o.n, CASE WHEN len(list_filter(f.taken, lambda t: o.start < t.e AND t.s < o."end")) = 0 THEN list_append(f.taken, struct_pack(s := o.start, e := o."end")) ELSE f.taken END, o.seq, o.tier, o.kind, len(list_filter(f.taken, lambda t: o.start < t.e AND t.s < o."end")) = 0
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.line_index = f.line_index AND o.n = f.n + 1)
 SELECT doc_id, line_index, seq, tier, kind FROM f WHERE ok""")
def resolved_claims(spark, sf_dir):
    return C.resolve(frame(spark, sf_dir, "claims")).select("doc_id", "line_index", "seq", "tier", "kind")


@query(f"""WITH {CLAIMS}, s AS (SELECT doc_id, line_index, start AS a, "end" AS b, max("end") OVER (PARTITION BY doc_id, line_index ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM claims),
 g AS (SELECT doc_id, line_index, coalesce(before, 0) AS start, a AS stop FROM s WHERE a > coalesce(before, 0) UNION ALL SELECT doc_id, line_index, max("end"), 80 FROM claims GROUP BY ALL HAVING max("end") < 80)
 SELECT doc_id, line_index, CAST(start AS INT) AS start, CAST(least(stop, 80) AS INT) AS stop FROM g WHERE start < 80""")
def uncovered_runs(spark, sf_dir):
    c = frame(spark, sf_dir, "claims")
    lines = c.select("doc_id", "line_index").distinct().withColumn("text", F.lit("x" * 80))
    return C.other_claims(lines, c).select("doc_id", "line_index", "start", F.col("end").alias("stop"))


@query(f"""WITH {CLAIMS} SELECT seq, CASE method WHEN 'regex' THEN 1 WHEN 'geometry_ner_reconstruction' THEN 5 WHEN 'geometry_semantic' THEN 5 ELSE 6 END AS worth, method IN ('geometry_ner_reconstruction', 'geometry_semantic') AS model FROM claims""")
def method_tiers(spark, sf_dir):
    return frame(spark, sf_dir, "claims").select("seq", C.tier_of(F.col("method")).alias("worth"), C.model_backed(F.col("method")).alias("model"))


@query(f"""WITH {LINES}, e AS (SELECT doc_id, count(*) AS n, min(regexp_extract(text, '[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}')) AS email FROM lines WHERE text LIKE '%@mail%' GROUP BY ALL),
 b AS (SELECT doc_id, arg_min(regexp_extract(text, 'Birth: ([^|]*\\S)\\s*\\|', 1), line_index) AS born, arg_min(regexp_extract(text, 'Nationality: (.*)$', 1), line_index) AS nation FROM lines WHERE text LIKE 'Date of Birth%' GROUP BY ALL),
 u AS (SELECT doc_id, count(DISTINCT regexp_extract(text, 'https?://[^\\s|,;)]+')) AS urls FROM lines WHERE text LIKE 'https%' GROUP BY ALL)
 SELECT h.doc_id, email, CAST(coalesce(n, 0) AS INT) AS phones, born, nation, CAST(coalesce(urls, 0) AS INT) AS urls FROM (SELECT DISTINCT doc_id FROM lines) h LEFT JOIN e USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN u USING (doc_id)""")
def contact_profiles(spark, sf_dir):
    li = _lines(spark, sf_dir)
    h = li.select("doc_id").distinct().join(resume.contact_profile(li), "doc_id", "left")
    p = F.col("header_profile")
    web = F.coalesce(F.size(F.filter(p["urls"], lambda u: u["url"].startswith("https"))), F.lit(0))
    phones = F.coalesce(F.size(F.filter(p["phones"], lambda x: x.startswith("+"))), F.lit(0))
    return h.select("doc_id", F.get(p["emails"], F.lit(0)).alias("email"), phones.alias("phones"), p["date_of_birth"].alias("born"), p["nationality"].alias("nation"), web.alias("urls"))


# -- geometry ---------------------------------------------------------------


@query(f"""WITH {BOXES}, p AS (SELECT a.doc_id, a.page, a.line_no AS i, b.line_no AS j, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page AND b.line_no = a.line_no + 3),
 o AS (SELECT *, least(ay1, by1) - greatest(ay0, by0) AS v, greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) AS h, least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0)) AS small FROM p)
 SELECT doc_id, i, j, round(v, 4) AS vertical, round(h, 4) AS horizontal, round(h * greatest(0, v) / small, 4) AS share FROM o""")
def box_overlaps(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    a = b.select("doc_id", "page", F.col("line_no").alias("i"), (F.col("line_no") + 3).alias("j"), F.col("bbox").alias("a"))
    p = a.join(b.select("doc_id", "page", F.col("line_no").alias("j"), F.col("bbox").alias("b")), ["doc_id", "page", "j"])
    x, y = F.col("a"), F.col("b")
    return p.select("doc_id", "i", "j", F.round(G.vertical_overlap(x, y), 4).alias("vertical"), F.round(G.horizontal_overlap(x, y), 4).alias("horizontal"), F.round(G.overlap_ratio(x, y), 4).alias("share"))


@query(f"""WITH {BOXES} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(round_even(min(x0) * 2, 0) AS INT) AS px FROM boxes GROUP BY doc_id, page""")
def page_hulls(spark, sf_dir):
    h = _boxes(spark, sf_dir).groupBy("doc_id", "page").agg(G.hull().alias("h"))
    return h.select("doc_id", "page", "h.*", G.pixel_box(F.col("h"))["x0"].alias("px"))


@query(f"""WITH {LINES}, e AS (SELECT doc_id, line_index, x0, x1, y0, y1, instr(text, '@') - 1 AS s, length(text) AS n, text FROM lines WHERE text LIKE '%@%')
 SELECT doc_id, line_index, round(x0 + (x1 - x0) * s / n, 4) AS left_edge, round(x0 + (x1 - x0) * (s + 1) / n, 4) AS right_edge FROM e""")
def span_boxes(spark, sf_dir):
    t = F.col("text")
    s = _lines(spark, sf_dir).select("doc_id", "line_index", "bbox", F.length("text").alias("n"), F.explode(find_all(t, "@")).alias("m"))
    b = G.span_box(F.col("bbox"), F.col("m.start"), F.col("m.end"), F.col("n"))
    return s.select("doc_id", "line_index", F.round(b["x0"], 4).alias("left_edge"), F.round(b["x1"], 4).alias("right_edge"))


@query(f"""WITH {LINES}, h AS (SELECT a.doc_id, a.line_index, a.x0, a.x1, a.y0, a.y1, b.line_index AS j, greatest(a.x0, b.x0) AS hx0, least(a.x1, b.x1) AS hx1, greatest(a.y0, b.y0) AS hy0, least(a.y1, b.y1) AS hy1 FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_index <> b.line_index),
 n AS (SELECT doc_id, line_index, arg_min(hx0, (abs((hx0 + hx1) / 2 - (x0 + x1) / 2), hx0)) AS hit FROM h WHERE hx1 > hx0 AND hy1 > hy0 GROUP BY ALL)
 SELECT l.doc_id, l.line_index, round(coalesce(hit, l.x0), 4) AS x0 FROM lines l LEFT JOIN n USING (doc_id, line_index)""")
def resolved_boxes(spark, sf_dir):
    li = _lines(spark, sf_dir)
    other = li.select("doc_id", "page", F.col("line_index").alias("j"), F.col("bbox").alias("o"))
    touch = "j != line_index AND o.x0 < bbox.x1 AND bbox.x0 < o.x1 AND o.y0 < bbox.y1 AND bbox.y0 < o.y1"
    hits = li.select("doc_id", "page", "line_index", "bbox").join(other, ["doc_id", "page"]).where(touch).groupBy("doc_id", "line_index").agg(F.collect_list("o").alias("hits"))
    full = li.join(hits, ["doc_id", "line_index"], "left")
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    box = G.resolved_box(F.col("bbox"), F.coalesce("hits", F.expr("cast(array() as array<struct<x0:double,y0:double,x1:double,y1:double>>)")), none)
    return full.select("doc_id", "line_index", F.round(box["x0"], 4).alias("x0"))


# -- statistics ---------------------------------------------------------------


@query(f"""WITH {BOXES}, s AS (SELECT doc_id, round_even(size, 1) AS size, sum(length(text)) AS n, min((page, line_no)) AS first_at FROM boxes WHERE size > 0 GROUP BY ALL)
 SELECT doc_id, size AS body_font_size FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) = 1""")
def body_sizes(spark, sf_dir):
    return ST.body_size(_boxes(spark, sf_dir).withColumn("span_no", F.lit(0)))


@query(f"""WITH {BOXES} SELECT doc_id, round(sum(CASE WHEN bold THEN length(text) ELSE 0 END) / sum(length(text)), 6) AS bold_ratio, round(median((x1 - x0) / length(text)), 6) AS char_width FROM boxes GROUP BY doc_id""")
def span_statistics(spark, sf_dir):
    s = ST.span_stats(_boxes(spark, sf_dir))
    return s.select("doc_id", F.round("bold_ratio", 6).alias("bold_ratio"), F.round("median_character_width", 6).alias("char_width"))


@query(f"""WITH {BOXES} SELECT doc_id, round_even(size, 1) AS size, count(*) AS n FROM boxes GROUP BY ALL""")
def font_histograms(spark, sf_dir):
    return ST.font_histogram(_boxes(spark, sf_dir))


_PAGE_STATS = f"""{BOXES}, m AS (SELECT *, lead(y0) OVER w AS ny FROM boxes WHERE {HORIZONTAL} AND {ALNUM('text')} >= 2 WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
 ps AS (SELECT doc_id, page, min(x0) AS lm, max(x1) AS rm, coalesce(median(y1 - y0), 0) AS lh, coalesce(median(CASE WHEN ny >= y0 AND ny - y1 >= 0 THEN ny - y1 END), 0) AS lg FROM m GROUP BY doc_id, page)"""


@query(f"WITH {_PAGE_STATS} SELECT doc_id, page, lm AS left_margin, rm AS right_margin, round(lh, 6) AS median_line_height, round(lg, 6) AS median_line_gap FROM ps")
def page_statistics(spark, sf_dir):
    p = ST.page_stats(ST.measurable(_boxes(spark, sf_dir)))
    return p.withColumns({c: F.round(c, 6) for c in ("median_line_height", "median_line_gap")})


@query(f"WITH {_PAGE_STATS} SELECT doc_id, round(median(lh), 6) AS median_line_height, round(coalesce(median(CASE WHEN lg > 0 THEN lg END), 0), 6) AS median_line_gap, min(CASE WHEN lm > 0 THEN lm END) AS left_margin, max(rm) AS right_margin FROM ps GROUP BY doc_id")
def document_statistics(spark, sf_dir):
    d = ST.doc_stats(ST.page_stats(ST.measurable(_boxes(spark, sf_dir))))
    return d.withColumns({c: F.round(c, 6) for c in ("median_line_height", "median_line_gap")})


_REPEATED = f"""{BOXES}, k AS (SELECT DISTINCT doc_id, page, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\d+', '#', 'g')) AS key, CASE WHEN y0 <= height * 0.15 THEN 'header' WHEN y1 >= height * 0.85 THEN 'footer' END AS band FROM boxes JOIN pages USING (doc_id, page) WHERE trim(text) <> ''),
 n AS (SELECT doc_id, count(*) AS pages FROM pages GROUP BY ALL HAVING count(*) >= 2), rep AS (SELECT k.doc_id, key, band FROM k JOIN n USING (doc_id) WHERE band IS NOT NULL GROUP BY k.doc_id, key, band, pages HAVING count(*) >= greatest(2, floor(pages * 0.6)))"""


@query(f"WITH {_REPEATED} SELECT * FROM rep")
def repeated_bands(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return ST.repeated_lines(b, _pages(b))


@query(f"""WITH {_REPEATED}, t AS (SELECT *, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\d+', '#', 'g')) AS key FROM boxes JOIN pages USING (doc_id, page) WHERE trim(text) <> ''),
 kept AS (SELECT * FROM t WHERE NOT (y0 <= height * 0.15 AND EXISTS (SELECT 1 FROM rep WHERE rep.doc_id = t.doc_id AND rep.key = t.key AND band = 'header')) AND NOT (y1 >= height * 0.85 AND EXISTS (SELECT 1 FROM rep WHERE rep.doc_id = t.doc_id AND rep.key = t.key AND band = 'footer')))
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) - 1 AS INT) AS line_index, page, line_no, trim(text) AS text FROM kept""")
def extracted(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return ST.extracted_lines(b, _pages(b)).select("doc_id", "line_index", "page", "line_no", "text")


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT doc_id, x0, row_number() OVER (PARTITION BY doc_id ORDER BY x0) AS n FROM (SELECT DISTINCT doc_id, x0 FROM boxes) d),
 f AS (SELECT doc_id, n, x0 AS level, true AS opens FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.n, CASE WHEN o.x0 - f.level > 5 THEN o.x0 ELSE f.level END, o.x0 - f.level > 5 FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)
 SELECT doc_id, round(level, 2) AS level, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY level) - 1 AS INT) AS no FROM f WHERE opens""")
def indent_levels(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return ST.indentation_levels(b, _widths(b)).select("doc_id", F.posexplode("levels").alias("no", "level"))


@query("""WITH e AS (SELECT user_id, CAST(value AS DOUBLE) AS s, CAST(value + 1.5 AS DOUBLE) AS e FROM events), c AS (SELECT user_id, greatest(s, 0) AS s, least(e, 50) AS e FROM e WHERE least(e, 50) > greatest(s, 0)),
 r AS (SELECT user_id, s, e, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
 SELECT user_id, round(before, 4) AS top, round(s, 4) AS bottom FROM r WHERE s > before UNION ALL SELECT user_id, round(max(e), 4), 50.0 FROM c GROUP BY user_id HAVING max(e) < 50""")
def free_intervals(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", F.col("value").alias("start"), (F.col("value") + 1.5).alias("end"), F.lit(0.0).alias("lo"), F.lit(50.0).alias("hi"))
    return ST.free_bands(e, ["user_id"]).select("user_id", F.round("top", 4).alias("top"), F.round("bottom", 4).alias("bottom"))


@query(f"""WITH {BOXES}, p AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r, min(y0) AS lo, max(y1) AS hi FROM boxes GROUP BY ALL HAVING count(*) >= 8),
 xs AS (SELECT doc_id, page, lo, hi, unnest(range(CAST(ceil(l) AS BIGINT) + 1, CAST(floor(r) AS BIGINT))) AS x FROM p),
 a AS (SELECT xs.*, b.y0, b.y1, CASE WHEN b.x1 <= x THEN 'l' WHEN b.x0 >= x THEN 'r' ELSE 'c' END AS side FROM xs JOIN boxes b USING (doc_id, page)),
 c AS (SELECT doc_id, page, x, lo, hi, y0, y1, coalesce(max(y1) OVER (PARTITION BY doc_id, page, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS before FROM a WHERE side = 'c'),
 bands AS (SELECT doc_id, page, x, lo, hi, before AS t, y0 AS b FROM c WHERE y0 > before UNION ALL SELECT doc_id, page, x, lo, hi, max(y1), hi FROM c GROUP BY ALL HAVING max(y1) < hi UNION ALL SELECT doc_id, page, x, lo, hi, lo, hi FROM xs WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = xs.doc_id AND a.page = xs.page AND a.x = xs.x AND side = 'c')),
 s AS (SELECT k.doc_id, k.page, k.x, k.t, k.b, k.lo, k.hi, count(*) FILTER (side = 'l') AS nl, count(*) FILTER (side = 'r') AS nr, min(y0) FILTER (side = 'l') AS lt, max(y1) FILTER (side = 'l') AS lb, min(y0) FILTER (side = 'r') AS rt, max(y1) FILTER (side = 'r') AS rb
   FROM bands k JOIN a ON a.doc_id = k.doc_id AND a.page = k.page AND a.x = k.x AND side <> 'c' AND y1 > t AND y0 < b WHERE b - t >= (k.hi - k.lo) * 0.5 GROUP BY ALL),
 g AS (SELECT doc_id, page, x, arg_max(struct_pack(t := t, b := b, nl := nl, nr := nr), (b - t, -t)) AS v FROM s WHERE nl >= 4 AND nr >= 4 AND least(lb, rb) - greatest(lt, rt) >= (hi - lo) * 0.5 GROUP BY ALL),
 i AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, page ORDER BY x) AS run FROM g)
 SELECT doc_id, page, CAST(min(x) AS DOUBLE) AS left_edge, CAST(max(x) AS DOUBLE) AS right_edge, arg_max(v.nl, (v.b - v.t, -x)) AS left_lines, arg_max(v.nr, (v.b - v.t, -x)) AS right_lines FROM i GROUP BY doc_id, page, run HAVING max(x) - min(x) >= 10""")
def column_gutters(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    g = ST.gutters(b, _widths(b))
    return g.select("doc_id", "page", F.col("left").alias("left_edge"), F.col("right").alias("right_edge"), "left_lines", "right_lines")


# -- layout ---------------------------------------------------------------

_BREAK = """is_space OR ptext IS NULL OR trim(ptext) = '' OR (gap >= 0 AND (coalesce(abs(origin_y - po) > 3, false) OR gap >= 2.5 OR ((font <> pf OR bold <> pb) AND gap >= 1.25)))"""


@query(f"""WITH {GLYPHS}, w AS (SELECT *, trim(text) = '' AS is_space, lag(text) OVER o AS ptext, x0 - lag(x1) OVER o AS gap, lag(origin_y) OVER o AS po, lag(font) OVER o AS pf, lag(bold) OVER o AS pb FROM glyphs WINDOW o AS (PARTITION BY doc_id, page, line_no ORDER BY span_no, tok_no)),
 r AS (SELECT *, sum(CASE WHEN {_BREAK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_no ORDER BY span_no, tok_no) AS run FROM w)
 SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY run) - 1 AS INT) AS word, string_agg(text, '' ORDER BY span_no, tok_no) AS text, round(min(x0), 4) AS x0, round(max(x1), 4) AS x1 FROM r WHERE NOT is_space GROUP BY doc_id, line_no, run""")
def glyph_words(spark, sf_dir):
    g = frame(spark, sf_dir, "glyphs").withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))
    w = L.words(g, F.lit(3.0))
    return w.select("doc_id", "line_no", "word", "text", F.round("bbox.x0", 4).alias("x0"), F.round("bbox.x1", 4).alias("x1"))


@query("""WITH e AS (SELECT user_id, event_id, value, CASE WHEN lag(event_id) OVER w IS NULL OR value - lag(value) OVER w >= 5 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)),
 r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS island FROM e) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, round(min(value), 4) AS low, round(max(value), 4) AS high FROM r GROUP BY user_id, island""")
def value_islands(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    run = L.islands(e, ["user_id"], ["value", "event_id"], F.lag("event_id").over(w).isNull() | (F.col("value") - F.lag("value").over(w) >= 5))
    return run.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"))


@query(f"""WITH {GLYPHS}, c AS (SELECT doc_id, line_no, tok_no, x0, x1, CASE WHEN lag(tok_no) OVER w IS NULL OR x0 - lag(x1) OVER w >= 3 THEN 1 ELSE 0 END AS b FROM glyphs WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY tok_no)),
 r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) - 1 AS cell FROM c) SELECT doc_id, line_no, CAST(cell AS BIGINT) AS cell, count(*) AS words, round(min(x0), 4) AS x0, round(max(x1), 4) AS x1 FROM r GROUP BY doc_id, line_no, cell""")
def line_cells(spark, sf_dir):
    w = frame(spark, sf_dir, "glyphs").withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).withColumn("word", F.col("tok_no"))
    return L.cells(w, F.lit(3.0)).select("doc_id", "line_no", "cell", "words", F.round("bbox.x0", 4).alias("x0"), F.round("bbox.x1", 4).alias("x1"))


@query(f"""WITH {GLYPHS} SELECT doc_id, line_no, median(origin_y) AS baseline FROM glyphs GROUP BY doc_id, line_no""")
def line_baselines(spark, sf_dir):
    g = frame(spark, sf_dir, "glyphs").withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))
    lines = g.groupBy("doc_id", "page", "line_no").agg(G.hull().alias("bbox"))
    return L.baselines(g, lines).select("doc_id", "line_no", "baseline")


_BASE = "y1 - CAST(line_no % 2 AS DOUBLE) * 0.25"


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT doc_id, page, line_no, x0, {_BASE} AS base, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, line_no) AS n FROM boxes),
 f AS (SELECT doc_id, n, page, line_no, [base] AS bases, 0 AS row FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.n, o.page, o.line_no, CASE WHEN o.page = f.page AND abs(o.base - list_median(f.bases)) <= 6 THEN list_append(f.bases, o.base) ELSE [o.base] END, CASE WHEN o.page = f.page AND abs(o.base - list_median(f.bases)) <= 6 THEN f.row ELSE f.row + 1 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)
 SELECT doc_id, page, row, line_no FROM f""".replace("list_median(f.bases)", "list_aggregate(f.bases, 'median')"))
def visual_rows(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumns({"baseline": F.expr(_BASE), "line_index": F.col("line_no"), "tol": F.lit(6.0)})
    return L.visual_rows(b, "tol").select("doc_id", "page", "row", F.col("line_index").alias("line_no"))


# two columns: what overlaps in height joins, unless the gutter at 250 to 280 runs between
@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT doc_id, page, line_no, x0, x1, {_BASE} AS base, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, line_no) AS n FROM boxes),
 f AS (SELECT doc_id, n, page, line_no, [base] AS bases, x0, x1, 0 AS row FROM o WHERE n = 1
  UNION ALL SELECT doc_id, n, page, line_no, CASE WHEN same THEN list_append(bases, base) ELSE [base] END, CASE WHEN same THEN least(x0, fx0) ELSE x0 END, CASE WHEN same THEN greatest(x1, fx1) ELSE x1 END, CASE WHEN same THEN row ELSE row + 1 END
   FROM (SELECT o.*, f.bases, f.x0 AS fx0, f.x1 AS fx1, f.row, o.page = f.page AND abs(o.base - list_aggregate(f.bases, 'median')) <= 6 AND NOT (CASE WHEN f.x0 <= o.x0 THEN f.x1 ELSE o.x1 END <= 250 AND greatest(f.x0, o.x0) >= 280) AS same FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1) j)
 SELECT doc_id, page, row, line_no FROM f""")
def rows_between_gutters(spark, sf_dir):
    gut = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(250.0).alias("left"), F.lit(280.0).alias("right")) for p in (1, 2, 3)])
    b = _boxes(spark, sf_dir).withColumns({"baseline": F.expr(_BASE), "line_index": F.col("line_no"), "tol": F.lit(6.0), "gut": gut})
    return L.visual_rows(b, "tol", "gut").select("doc_id", "page", "row", F.col("line_index").alias("line_no"))


@query(f"""WITH {BOXES}, t AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 0 THEN NULL ELSE line_no // 4 END AS tbl, line_no // 2 AS r FROM boxes),
 b AS (SELECT *, CASE WHEN tbl IS NOT NULL AND lag(tbl) OVER w = tbl AND lag(r) OVER w = r THEN 0 ELSE 1 END AS opens FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
 SELECT doc_id, line_no, CAST(sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS row_no FROM b""")
def stated_rows(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    t = b.select("doc_id", F.col("line_no").alias("line_index"), F.when(F.col("line_no") % 4 != 0, F.floor(F.col("line_no") / 4)).alias("tbl"), F.floor(F.col("line_no") / 2).alias("row"))
    return L.stated_rows(t).select("doc_id", F.col("line_index").alias("line_no"), "row_no")


@query(f"""WITH RECURSIVE {LINES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS n FROM lines WHERE text NOT LIKE '%(%'),
 f AS (SELECT doc_id, n, page, x0, x1, y1, 0 AS block, line_index FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.n, o.page, o.x0, o.x1, o.y1, CASE WHEN o.page = f.page AND o.y0 - f.y1 >= -2 AND o.y0 - f.y1 <= 5 AND least(o.x1, f.x1) > greatest(o.x0, f.x0) THEN f.block ELSE f.block + 1 END, o.line_index FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1),
 t AS (SELECT doc_id, block, count(*) AS lines FROM f GROUP BY ALL) SELECT doc_id, block, CAST(lines AS INT) AS lines FROM t""")
def line_blocks(spark, sf_dir):
    li = _lines(spark, sf_dir).where(~F.col("text").contains("(")).withColumns({"paragraph_gap": F.lit(5.0), "line_height": F.lit(10.0)})
    return L.paragraphs(li).select("doc_id", "block", "lines")


# brackets of a line: what they add up to, and how deep they fall below their start
_BRACKETS = """br AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY line_index) AS n, coalesce(list_sum(d), 0) AS total, coalesce(list_min(list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i]))), 0) AS low
  FROM (SELECT *, list_transform(regexp_extract_all({text}, '[()\\[\\]]'), lambda c: CASE WHEN c IN ('(', '[') THEN 1 ELSE -1 END) AS d FROM {rows}) x)"""
# depth after a line, and lines since the bracket that is still open was opened
_DEPTH = "{d} + o.total - least(0, {d} + o.low)"
_SINCE = "CASE WHEN {d} > 0 AND {d} + o.low >= 1 THEN {s} + 1 ELSE 0 END"
_ON = "o.page = f.page AND o.y0 - f.y1 >= -2 AND (o.y0 - f.y1 <= {gap} OR (f.depth > 0 AND o.y0 - f.y1 <= 30 AND f.since < 3)) AND least(o.x1, f.x1) > greatest(o.x0, f.x0)"


@query(f"""WITH RECURSIVE {LINES}, {_BRACKETS.format(keys='doc_id', text='text', rows='lines')},
 f AS (SELECT doc_id, n, line_index, page, text, x0, x1, y1, total - least(0, low) AS depth, 0 AS since, 0 AS block FROM br WHERE n = 1
  UNION ALL SELECT doc_id, n, line_index, page, text, x0, x1, y1, CASE WHEN go THEN {_DEPTH.format(d='depth').replace('o.', '')} ELSE total - least(0, low) END, CASE WHEN go THEN {_SINCE.format(d='depth', s='since').replace('o.', '')} ELSE 0 END, CASE WHEN go THEN block ELSE block + 1 END
   FROM (SELECT o.doc_id, o.n, o.line_index, o.page, o.text, o.x0, o.x1, o.y1, o.total, o.low, f.depth, f.since, f.block, {_ON.format(gap='3')} AS go FROM f JOIN br o ON o.doc_id = f.doc_id AND o.n = f.n + 1) j)
 SELECT doc_id, block, min(page) AS page, string_agg(text, chr(10) ORDER BY line_index) AS text, CAST(count(*) AS INT) AS lines FROM f GROUP BY doc_id, block""")
def bracketed_blocks(spark, sf_dir):
    """With open brackets that reach over gaps."""
    li = _lines(spark, sf_dir).withColumns({"paragraph_gap": F.lit(3.0), "line_height": F.lit(10.0)})
    return L.paragraphs(li)


@query(f"""WITH {BOXES} SELECT doc_id, page, count(*) AS n, arg_min(x0, line_no) AS x0 FROM boxes WHERE NOT ({HORIZONTAL}) AND trim(text) <> '' GROUP BY doc_id, page""")
def turned_text(spark, sf_dir):
    v = L.vertical_text(_boxes(spark, sf_dir))
    return v.select("doc_id", "page", F.regexp_extract("detail", r"^(\d+)", 1).cast("long").alias("n"), "bbox.x0")


@query(f"""WITH {BOXES}, t AS (SELECT * FROM boxes WHERE trim(text) <> ''), p AS (SELECT a.doc_id, a.page, a.line_no AS i, b.line_no AS j, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS share
 FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_no < b.line_no) SELECT doc_id, page, 'lines ' || CAST(min((i, j))[1] AS STRING) || ' and ' || CAST(min((i, j))[2] AS STRING) || ' cover each other' AS detail FROM p WHERE share >= 0.5 GROUP BY doc_id, page""")
def text_over_text(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("bbox", F.struct("x0", (F.col("y0") - F.col("line_no") * 0.0).alias("y0"), "x1", "y1"))
    return L.overlapping_text(b).select("doc_id", "page", "detail")


_IMAGES = "im AS (SELECT doc_id, page, line_no AS region_no, x0 - 2.0 AS ix0, y0 - 2.0 AS iy0, x1 + 2.0 AS ix1, y1 + 14.0 AS iy1 FROM boxes WHERE line_no % 17 = 0)"


@query(f"""WITH {BOXES}, {_IMAGES}, o AS (SELECT im.doc_id, im.page, region_no, greatest(0, least(x1, ix1) - greatest(x0, ix0)) * greatest(0, least(y1, iy1) - greatest(y0, iy0)) / least((x1 - x0) * (y1 - y0), (ix1 - ix0) * (iy1 - iy0)) AS share, (ix1 - ix0) * (iy1 - iy0) AS area, 612.0 * height AS whole
  FROM im JOIN boxes USING (doc_id, page) JOIN pages USING (doc_id, page) WHERE trim(text) <> ''), c AS (SELECT doc_id, page, region_no, count(*) AS n FROM o WHERE area < whole * 0.7 AND share >= 0.9 GROUP BY ALL)
 SELECT doc_id, page, arg_min(n, region_no) AS n FROM c GROUP BY doc_id, page""")
def text_in_images(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return L.text_in_graphics(b, _image_boxes(b), _pages(b)).select("doc_id", "page", F.regexp_extract("detail", r"^(\d+)", 1).cast("long").alias("n"))


def _image_boxes(b):
    region = F.struct((F.col("x0") - 2).alias("x0"), (F.col("y0") - 2).alias("y0"), (F.col("x1") + 2).alias("x1"), (F.col("y1") + 14).alias("y1"))
    return b.where("line_no % 17 = 0").select("doc_id", "page", F.col("line_no").alias("region_no"), region.alias("region"))


_RULES = "ru AS (SELECT doc_id, page, line_no, CASE WHEN line_no % 2 = 0 THEN 40.0 ELSE 60.0 + line_no % 7 END AS x0, CASE WHEN line_no % 2 = 0 THEN 540.0 ELSE 160.0 + line_no % 7 END AS x1, y0, y0 + line_no % 4 AS y1 FROM boxes)"


@query(f"""WITH {BOXES}, {_RULES}, h AS (SELECT *, round_even(x0 / 2, 0) AS e0, round_even(x1 / 2, 0) AS e1 FROM ru WHERE y1 - y0 <= 2 AND x1 - x0 >= 10),
 g AS (SELECT doc_id, page, e0 AS g0, e1 AS g1, min(x0) AS l, max(x1) AS r, min(y0) AS t, max(y1) AS b FROM h GROUP BY ALL HAVING count(*) >= 3),
 i AS (SELECT h.doc_id, h.page, h.y0, g.t, h.x0 FROM h JOIN g ON h.doc_id = g.doc_id AND h.page = g.page AND NOT (e0 = g0 AND e1 = g1) AND t < h.y0 AND h.y1 < b AND h.x0 >= l AND h.x1 <= r AND h.x1 - h.x0 < (r - l) * 0.9)
 SELECT doc_id, page, arg_min(y0, (t, y0)) AS y0 FROM i GROUP BY doc_id, page""")
def nested_rules(spark, sf_dir):
    return L.nested_tables(_rule_boxes(_boxes(spark, sf_dir))).select("doc_id", "page", "bbox.y0")


def _rule_boxes(b):
    even = F.col("line_no") % 2 == 0
    x0, x1 = F.when(even, 40.0).otherwise(60.0 + F.col("line_no") % 7), F.when(even, 540.0).otherwise(160.0 + F.col("line_no") % 7)
    r = b.select("doc_id", "page", F.struct(x0.alias("x0"), F.col("y0"), x1.alias("x1"), (F.col("y0") + F.col("line_no") % 4).alias("y1")).alias("bbox"))
    kind = physical.rule_kind(F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0"))
    return r.withColumn("orientation", kind).where("orientation is not null")


_LINKS = "lk AS (SELECT doc_id, page, line_no AS link_no, 'https://x.example/' || CAST(line_no AS STRING) AS uri, x0 + 3 AS rx0, y0 + 2 AS ry0, x1 - 20 AS rx1, y1 + 1 AS ry1 FROM boxes WHERE line_no % 9 = 0)"


@query(f"""WITH {BOXES}, {_LINKS}, p AS (SELECT lk.doc_id, lk.page, link_no, line_no, x0 < rx1 AND rx0 < x1 AND y0 < ry1 AND ry0 < y1 AS touch, abs((y0 + y1) / 2 - (ry0 + ry1) / 2) AS d FROM lk JOIN boxes USING (doc_id, page) WHERE x0 < rx1 + 2 AND rx0 - 2 < x1 AND y0 < ry1 + 2 AND ry0 - 2 < y1)
 SELECT doc_id, page, link_no, arg_min(line_no, (CASE WHEN touch THEN 0 ELSE 1 END, d, line_no)) AS line_no FROM p GROUP BY doc_id, page, link_no""")
def links_to_lines(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    lk = _link_boxes(b)
    return L.link_lines(lk, b.withColumn("line_index", F.col("line_no"))).select("doc_id", "page", "link_no", F.col("line_index").alias("line_no"))


def _link_boxes(b):
    rect = F.struct((F.col("x0") + 3).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x1") - 20).alias("x1"), (F.col("y1") + 1).alias("y1"))
    return b.where("line_no % 9 = 0").select("doc_id", "page", F.col("line_no").alias("link_no"), F.concat(F.lit("https://x.example/"), F.col("line_no").cast("string")).alias("uri"), rect.alias("rect"))


@query(f"""WITH {BOXES}, {_LINKS}, p AS (SELECT boxes.doc_id, boxes.page, line_no, link_no, uri, greatest(0, least(x1, rx1 + 2) - greatest(x0, rx0 - 2)) * greatest(0, least(y1, ry1 + 2) - greatest(y0, ry0 - 2)) AS shared, (x1 - x0) * (y1 - y0) AS area FROM boxes JOIN lk USING (doc_id, page)),
 h AS (SELECT doc_id, page, line_no, arg_min(uri, link_no) AS uri FROM p WHERE area > 0 AND shared >= area * 0.5 GROUP BY ALL) SELECT b.doc_id, b.page, b.line_no, h.uri FROM boxes b LEFT JOIN h USING (doc_id, page, line_no)""")
def words_under_links(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return L.linked_words(b.withColumn("word", F.lit(0)), _link_boxes(b)).select("doc_id", "page", "line_no", "uri")


# -- structure ---------------------------------------------------------------

_STRONG = "lower(regexp_replace(text, '^\\d+\\. ', '')) IN ('work experience', 'education', 'technical skills')"


@query(f"""WITH {LINES}, m AS (SELECT doc_id, page, median(size) AS ps FROM lines GROUP BY ALL) SELECT doc_id, line_index FROM lines JOIN m USING (doc_id, page)
 WHERE {WORDS('text')} BETWEEN 1 AND 8 AND length(text) <= 80 AND text NOT LIKE '%@%' AND NOT regexp_matches(text, '^(https?://|www\\.)') AND NOT regexp_matches(text, '[.,;:]$')
 AND (bold OR length(regexp_replace(text, '[^A-Z]', '', 'g')) >= 0.8 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) OR size >= ps * 1.12)""")
def heading_lines(spark, sf_dir):
    return R.heading_candidates(_lines(spark, sf_dir)).select("doc_id", "line_index")


_HEADINGS = "hd AS (SELECT doc_id, line_index, CASE WHEN text = 'EDUCATION' THEN 'education' WHEN text = 'Work Experience' THEN 'experience' ELSE 'skills' END AS section_type FROM lines WHERE text IN ('EDUCATION', 'Work Experience', '2. Technical Skills'))"


def _headings(lines):
    return lines.where(R.exact_section(T.heading_text(F.col("text"))).isNotNull()).select("doc_id", "line_index", R.exact_section(T.heading_text(F.col("text"))).alias("section_type"), F.lit(1.0).alias("similarity"), F.lit(0.0).alias("runner_up"))


@query(f"WITH {LINES}, {_HEADINGS} SELECT doc_id, min(line_index) AS boundary FROM hd JOIN lines USING (doc_id, line_index) WHERE page = 1 AND line_index > 0 GROUP BY doc_id")
def header_boundaries(spark, sf_dir):
    li = _lines(spark, sf_dir)
    return R.header_boundary(li, _headings(li))


@query(f"""WITH {LINES}, {_HEADINGS}, a AS (SELECT l.*, max(CASE WHEN h.line_index IS NOT NULL THEN h.line_index END) OVER w AS heading_line FROM lines l LEFT JOIN hd h USING (doc_id, line_index) WINDOW w AS (PARTITION BY doc_id ORDER BY l.line_index))
 SELECT a.doc_id, a.line_index, heading_line, section_type FROM a JOIN hd ON hd.doc_id = a.doc_id AND hd.line_index = heading_line WHERE a.line_index > heading_line""")
def lines_of_sections(spark, sf_dir):
    li = _lines(spark, sf_dir)
    h = _headings(li).withColumn("heading_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_index")))
    return R.section_lines(li, h).select("doc_id", "line_index", "heading_line", "section_type")


@query(f"""WITH {LINES} SELECT DISTINCT a.doc_id, a.line_index FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_index <> b.line_index WHERE b.x0 > a.x1 + greatest(2, a.size * 0.5) AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= least(a.y1 - a.y0, b.y1 - b.y0) * 0.45""")
def content_to_the_right(spark, sf_dir):
    li = _lines(spark, sf_dir).withColumn("bbox", F.struct("x0", "y0", "x1", "y1"))
    return R.right_neighbours(li, li)


_ORD = "coalesce(nullif(regexp_replace({0}, '^\\s*(?:\\d{{1,2}}|[IVXivx]{{1,4}})\\s*[.)\\]:–—-]?\\s+', ''), ''), {0})".format
_CAPITALS = "CASE WHEN regexp_matches({0}, '[A-Za-z]') THEN length(regexp_replace({0}, '[^A-Z]', '', 'g')) / length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) ELSE 0 END".format
_BULLETED = "regexp_matches({0}, '^\\s*(?:[-+*•●▪◦‣¢]|\\d+[.)])')".format
_ROUTED = f"""{_HEADINGS}, cand AS (SELECT l.*, {_ORD('text')} AS h, hd.section_type IS NOT NULL AS strong, coalesce(hd.section_type, 'others') AS st FROM lines l LEFT JOIN hd USING (doc_id, line_index)),
 beside AS (SELECT DISTINCT a.doc_id, a.line_index, true AS beside FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line_index <> b.line_index WHERE {WORDS('a.text')} <= 8 AND b.x0 > a.x1 + greatest(2, a.size * 0.5) AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= least(a.y1 - a.y0, b.y1 - b.y0) * 0.45),
 peers AS (SELECT *, h <> '' AND NOT {_BULLETED('h')} AND length(h) <= 80 AND {WORDS('h')} <= 8 AND ({_CAPITALS('h')} >= 0.8 OR bold) AS peer FROM cand),
 maybe AS (SELECT p.*, coalesce(b.beside, false) AS beside, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.line_index) AS n FROM peers p LEFT JOIN beside b ON b.doc_id = p.doc_id AND b.line_index = p.line_index WHERE strong OR peer),
 fold AS (SELECT doc_id, n, line_index, st, strong AS kept, CASE WHEN strong THEN 0 ELSE -1 END AS no, CASE WHEN strong THEN st END AS lt, CASE WHEN strong THEN size END AS ls, CASE WHEN strong THEN x0 END AS lx, CASE WHEN strong THEN page END AS lp FROM maybe WHERE n = 1
  UNION ALL SELECT doc_id, n, line_index, st, keep, CASE WHEN keep THEN no + 1 ELSE no END, CASE WHEN keep THEN st ELSE lt END, CASE WHEN keep THEN size ELSE ls END, CASE WHEN keep THEN x0 ELSE lx END, CASE WHEN keep THEN page ELSE lp END
   FROM (SELECT m.doc_id, m.n, m.line_index, m.st, m.size, m.x0, m.page, f.no, f.lt, f.ls, f.lx, f.lp, (m.strong OR coalesce(f.no >= 0 AND m.peer AND m.size >= f.ls * 0.98 AND m.st <> f.lt, false)) AND NOT coalesce(f.no >= 0 AND m.page >= f.lp AND m.size < f.ls * 0.98 AND m.x0 > f.lx + greatest(4.0, f.ls * 0.5) AND m.beside, false) AS keep
    FROM fold f JOIN maybe m ON m.doc_id = f.doc_id AND m.n = f.n + 1) j),
 routed AS (SELECT doc_id, no AS heading_no, line_index, st AS section_type FROM fold WHERE kept)"""


@query(f"WITH RECURSIVE {LINES}, {_ROUTED} SELECT doc_id, heading_no, line_index, section_type, CASE WHEN section_type = 'others' THEN 0.0 ELSE 1.0 END::DOUBLE AS similarity, 0.0::DOUBLE AS runner_up FROM routed")
def routed_headings(spark, sf_dir):
    li = _lines(spark, sf_dir)
    return R.routed_headings(li, _headings(li))


@query(f"""WITH {LINES}, {_HEADINGS}, a AS (SELECT l.*, CAST((x0 - 40) / 18 AS INT) AS level, max(CASE WHEN h.line_index IS NOT NULL THEN h.line_index END) OVER w AS hl FROM lines l LEFT JOIN hd h USING (doc_id, line_index) WINDOW w AS (PARTITION BY doc_id ORDER BY l.line_index)),
 u AS (SELECT *, coalesce(lag(page) OVER w = page AND level > lag(level) OVER w, false) AS wrapped FROM a WHERE hl IS NOT NULL AND line_index > hl WINDOW w AS (PARTITION BY doc_id, hl ORDER BY line_index)),
 p AS (SELECT *, ({WORDS('text')} > 12 OR regexp_matches(text, '[.,;:]$')) AND NOT wrapped AS prose FROM u)
 SELECT doc_id, hl AS heading_line, CASE WHEN bool_or(prose) THEN median(CASE WHEN prose THEN size END) ELSE median(size) END AS body_size, CASE WHEN bool_or(prose) THEN count(*) FILTER (prose AND bold) * 2 > count(*) FILTER (prose) ELSE count(*) FILTER (bold) * 2 > count(*) END AS body_bold, min(level) AS body_level FROM p GROUP BY doc_id, hl""")
def body_styles(spark, sf_dir):
    li = _lines(spark, sf_dir)
    h = _headings(li).withColumn("heading_no", F.col("line_index"))
    under = R.section_lines(li, h).withColumn("level", ((F.col("x0") - 40) / 18).cast("int"))
    return R.body_style(under).select("doc_id", F.col("heading_no").alias("heading_line"), "body_size", "body_bold", "body_level")


def _section_of(x: str) -> str:
    """SQL of the section that a text names word for word."""
    folded = f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"
    quote = lambda p: "'" + p.lower().replace("'", "''") + "'"
    return f"CASE {' '.join(f'WHEN {folded} IN (' + ', '.join(map(quote, names)) + f') THEN {quote(kind)}' for kind, names in R.SECTIONS.items())} END"


_MARKER = "trim(regexp_replace(trim({0}), '^\\s*(?:[-+*•●▪◦‣¢]|\\d+[.)])\\s*', ''))".format
# lines below their headings, with indentation level, body style and whether they are set like subheadings
_BODY = f"""{_ROUTED}, lefts AS (SELECT doc_id, x0, row_number() OVER (PARTITION BY doc_id ORDER BY x0) AS n FROM (SELECT DISTINCT doc_id, x0 FROM lines) d),
 lv AS (SELECT doc_id, n, x0 AS level, true AS opens FROM lefts WHERE n = 1 UNION ALL SELECT o.doc_id, o.n, CASE WHEN o.x0 - f.level > 5 THEN o.x0 ELSE f.level END, o.x0 - f.level > 5 FROM lv f JOIN lefts o ON o.doc_id = f.doc_id AND o.n = f.n + 1),
 levels AS (SELECT doc_id, list(round_even(level, 2) ORDER BY level) AS ls FROM lv WHERE opens GROUP BY doc_id),
 marked AS (SELECT l.*, last_value(r.heading_no IGNORE NULLS) OVER w AS heading_no, last_value(r.section_type IGNORE NULLS) OVER w AS section_type, max(r.line_index) OVER w AS heading_line FROM lines l LEFT JOIN routed r ON r.doc_id = l.doc_id AND r.line_index = l.line_index WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 under AS (SELECT m.*, coalesce(list_position(list_transform(ls, lambda v: abs(x0 - v) <= 5), true) - 1, len(ls)) AS level FROM marked m JOIN levels USING (doc_id) WHERE heading_no IS NOT NULL AND line_index > heading_line),
 wrapped AS (SELECT *, coalesce(lag(page) OVER w = page AND level > lag(level) OVER w, false) AS wrapped FROM under WINDOW w AS (PARTITION BY doc_id, heading_no ORDER BY line_index)),
 prosed AS (SELECT *, ({WORDS('text')} > 12 OR regexp_matches(rtrim(text), '[.,;:]$')) AND NOT wrapped AS prose FROM wrapped),
 style AS (SELECT doc_id, heading_no, CASE WHEN bool_or(prose) THEN median(CASE WHEN prose THEN size END) ELSE median(size) END AS body_size, CASE WHEN bool_or(prose) THEN count(*) FILTER (prose AND bold) * 2 > count(*) FILTER (prose) ELSE count(*) FILTER (bold) * 2 > count(*) END AS body_bold, min(level) AS body_level FROM prosed GROUP BY ALL),
 body AS (SELECT u.*, t.text AS heading_text, trim(u.text) <> '' AND NOT regexp_matches(trim(u.text), '[.,;:]$') AND level <= body_level AND length(trim(u.text)) <= 100 AND {WORDS('u.text')} <= 12 AND ((body_size > 0 AND u.size >= body_size * 1.08) OR (u.bold AND NOT body_bold)) AS subheading
  FROM under u JOIN style USING (doc_id, heading_no) JOIN lines t ON t.doc_id = u.doc_id AND t.line_index = u.heading_line)"""


@query(f"""WITH RECURSIVE {LINES}, {_BODY},
 pieces AS (SELECT *, list_filter(list_transform(regexp_split_to_array(heading_text, '(?i)\\s*(?:\\bas\\s+well\\s+as\\b|\\balong\\s+with\\b|\\band\\b|\\bwith\\b|\\bplus\\b|[&+/|,;])\\s*'), lambda x: trim(x)), lambda x: length(x) >= 2 AND regexp_matches(x, '\\p{{L}}')) AS ps, {_section_of('heading_text')} AS whole FROM body),
 parts AS (SELECT *, CASE WHEN whole IS NOT NULL OR len(ps) = 0 THEN [heading_text] ELSE ps END AS cs FROM pieces),
 named AS (SELECT *, list_filter(list_transform(cs, lambda x: {{'t': lower(x), 's': {_section_of('x')}}}), lambda c: c.s IS NOT NULL) AS ks, {_MARKER('text')} AS bare FROM parts),
 label AS (SELECT *, lower(trim(regexp_replace(regexp_extract(bare, '^([^:\\t]{{1,60}}):\\s*(.+)$', 1), '\\s+', ' ', 'g'))) AS lab, CASE WHEN subheading THEN {_section_of('bare')} END AS local FROM named),
 claim AS (SELECT *, subheading AND coalesce(list_contains(list_transform(ks, lambda c: c.s), local), false) AS is_run,
  CASE WHEN regexp_matches(bare, '^([^:\\t]{{1,60}}):\\s*(.+)$') THEN coalesce(list_filter(ks, lambda c: c.t = lab OR c.s = {_section_of('lab')})[1].s, CASE WHEN list_contains(list_transform(ks, lambda c: c.s), 'languages') AND lab IN ({', '.join("'" + x.lower() + "'" for x in P.LANGUAGES)}) THEN 'languages' END) END AS own FROM label),
 runs AS (SELECT *, nullif(last_value(CASE WHEN is_run THEN local WHEN subheading THEN '' END IGNORE NULLS) OVER (PARTITION BY doc_id, heading_no ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS run FROM claim),
 owned AS (SELECT *, CASE WHEN is_run THEN local ELSE coalesce(own, run) END AS owner FROM runs)
 SELECT doc_id, heading_no, line_index, section_type, CASE WHEN len(cs) < 2 THEN section_type WHEN len(ks) = 0 THEN 'others' WHEN NOT bool_or(owner IS NOT NULL) OVER (PARTITION BY doc_id, heading_no) THEN ks[1].s ELSE coalesce(owner, 'others') END AS logical_type, len(cs) >= 2 AS compound FROM owned""")
def logical_sections(spark, sf_dir):
    li = _lines(spark, sf_dir)
    return R.logical_sections(resume.body_lines(li, R.routed_headings(li, _headings(li)), _widths(li))).select("doc_id", "heading_no", "line_index", "section_type", "logical_type", "compound")


@query(f"""WITH {LINES}, b AS (SELECT doc_id, line_index, trim(regexp_replace(text, '^\\s*(?:[-+*•●▪◦‣¢]|\\d+[.)])\\s*', '')) AS t FROM lines)
 SELECT doc_id, line_index, CASE WHEN regexp_matches(t, '^Languages:') THEN 'languages' WHEN regexp_matches(t, '^Thai:') THEN 'languages' END AS owner FROM b WHERE regexp_matches(t, '^(Languages|Thai):')""")
def line_owners(spark, sf_dir):
    parts = R.heading_components(F.lit("Certifications & Languages"))
    li = _lines(spark, sf_dir).select("doc_id", "line_index", R.block_owner(F.col("text"), parts).alias("owner"))
    return li.where("owner is not null")


# -- records of sections ---------------------------------------------------------------


def _experience(spark, sf_dir):
    t = F.col("text")
    li = _lines(spark, sf_dir)
    return li.select("doc_id", F.lit(0).alias("heading_no"), "line_index", t.rlike(P.BULLET).alias("bullet"), "bold", t.rlike(P.DATE_RANGE).alias("has_range"), (t.rlike(P.DATE_RANGE) | t.contains(" @ ")).alias("primary"), t.rlike(P.LOCATION).alias("place"))


@query(f"""WITH RECURSIVE {LINES}, o AS (SELECT doc_id, line_index, regexp_matches(text, '^\\s*(?:[-+*•●▪◦‣¢]|\\d+[.)])') AS bullet, bold, text LIKE '% @ %' OR text LIKE 'Jan %' AS prim, regexp_matches(text, '^[^\\d@]{{2,48}},\\s*[^\\d@]{{2,48}}$') AS place FROM lines),
 s AS (SELECT doc_id, line_index, bullet, bold, prim, place, bold OR prim AS again FROM o),
 f AS (SELECT doc_id, line_index, 0 AS record, CASE WHEN bullet THEN 'bullet' WHEN prim THEN 'metadata' ELSE 'body' END AS role, NOT (NOT bullet AND prim) AS body FROM s WHERE line_index = 0
  UNION ALL SELECT s.doc_id, s.line_index, CASE WHEN NOT s.bullet AND s.prim AND f.body THEN f.record + 1 ELSE f.record END,
   CASE WHEN s.bullet THEN 'bullet' WHEN (s.prim AND (NOT f.body OR s.again)) OR (s.place AND NOT f.body) THEN 'metadata' ELSE 'body' END,
   CASE WHEN NOT s.bullet AND ((s.prim AND (NOT f.body OR s.again)) OR (s.place AND NOT f.body)) THEN false ELSE true END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.line_index = f.line_index + 1)
 SELECT doc_id, line_index, record, role FROM f""")
def experience_records(spark, sf_dir):
    return X.experience_roles(_experience(spark, sf_dir)).select("doc_id", "line_index", "record", "role")


_SPAN = "(?i)\\b(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+)?(?:19|20)\\d{{2}}\\s*[-–]\\s*(?:(?:19|20)\\d{{2}}|Present|Current|Now)\\b".replace("{{", "{").replace("}}", "}")


@query(f"""WITH RECURSIVE {LINES}, e AS (SELECT doc_id, line_index, bold, text, regexp_matches(text, '{_SPAN}') AS ranged, regexp_matches(text, '\\b(?:19|20)\\d{{2}}\\b') AS dated, regexp_matches(text, '(?i)\\bgpa\\s*:?[\\s-]*\\d') AS gpa, regexp_matches(text, '(?i)\\b(?:bachelor|associate|degree|diploma|certificate|graduate)\\b') AS degree, regexp_matches(text, '(?i)\\b(?:university|college|institute|school|academy)\\b') AS institution, {WORDS('text')} AS w FROM lines),
 x AS (SELECT *, ranged OR gpa OR degree OR institution AS explicit, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS n FROM e),
 r AS (SELECT *, NOT (explicit AND (bold OR regexp_matches(text, '[|•·–—]|\\s-\\s') OR w <= 12)) AND (w > 12 OR regexp_matches(text, '[.;:]$')) AS prose, w <= 12 AS short FROM x),
 f AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, -1 AS line_index, -1 AS record, false AS body, false AS t, false AS i, false AS d, '' AS role FROM (SELECT DISTINCT doc_id FROM r) q
  UNION ALL SELECT doc_id, n, line_index, CASE WHEN opens THEN record + 1 ELSE record END, CASE WHEN meta OR tail THEN body AND NOT opens ELSE true END, CASE WHEN opens THEN meta AND nt ELSE t OR (meta AND nt) END, CASE WHEN opens THEN meta AND ni ELSE i OR (meta AND ni) END, CASE WHEN opens THEN meta AND nd ELSE d OR (meta AND nd) END, CASE WHEN meta THEN 'metadata' WHEN tail THEN 'title_tail' ELSE 'body' END
  FROM (SELECT *, (meta AND (record < 0 OR ((nt OR ni OR nd) AND body) OR (record >= 0 AND ((ni AND i) OR (nd AND d) OR (nt AND t AND i))))) OR (NOT meta AND NOT tail AND record < 0) AS opens
   FROM (SELECT *, NOT meta AND record >= 0 AND NOT body AND t AND NOT i AND short AS tail
    FROM (SELECT *, nt OR ni OR nd OR (reads AND gpa) AS meta FROM (SELECT *, reads AND degree AS nt, reads AND institution AS ni, reads AND dated AS nd
     FROM (SELECT f.doc_id, r.n, r.line_index, f.record, f.body, f.t, f.i, f.d, r.degree, r.institution, r.dated, r.gpa, r.short, NOT (r.prose OR (f.record >= 0 AND f.body AND NOT r.explicit)) AS reads FROM f JOIN r ON r.doc_id = f.doc_id AND r.n = f.n + 1) a) b) c) g) h)
 SELECT doc_id, line_index, record, role FROM f WHERE n > 0""")
def education_records(spark, sf_dir):
    t = F.col("text")
    ev = X.line_evidence(_lines(spark, sf_dir)).withColumn("heading_no", F.lit(0)).withColumn("row", F.col("line_index"))
    explicit = (F.size("ranges") > 0) | (F.size("gpa") > 0) | F.col("has_degree") | F.col("has_institution")
    shaped = explicit & (F.col("bold") | t.rlike(P.METADATA_SEPARATOR) | (T.word_count(t) <= 12))
    prose = t.rlike(P.COURSEWORK) | (~shaped & ((T.word_count(t) > 12) | t.rlike("[.;:]$")))
    rows = ev.withColumns({"explicit": explicit, "prose": prose, "titles": F.col("has_degree"), "institutions": F.col("has_institution"), "dates": F.size("dates") > 0, "other": F.size("gpa") > 0, "short": T.word_count(t) <= 12})
    return X.education_roles(rows).select("doc_id", F.col("row").alias("line_index"), "record", "role")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_index, text FROM lines WHERE text LIKE 'Bachelor%' OR text LIKE 'GPA%')
 SELECT doc_id, line_index, 'title' AS field, regexp_replace(text, ',\\s*\\d{{4}}$', '') AS text FROM s WHERE text LIKE 'Bachelor%' UNION ALL SELECT doc_id, line_index, 'institution', regexp_replace(text, ',\\s*\\d{{4}}$', '') FROM s WHERE text LIKE 'Bachelor%'
 UNION ALL SELECT doc_id, line_index, 'date', regexp_extract(text, '\\d{{4}}$') FROM s WHERE text LIKE 'Bachelor%' UNION ALL SELECT doc_id, line_index, 'gpa', text FROM s WHERE text LIKE 'GPA%'""")
def education_evidence(spark, sf_dir):
    li = _lines(spark, sf_dir).where(F.col("text").startswith("Bachelor") | F.col("text").startswith("GPA"))
    return X.education_fields(li)


@query(f"""WITH {LINES}, k AS (SELECT doc_id, line_index, CASE WHEN regexp_matches(text, '^(Languages|Thai|GPA|Date of Birth):') THEN regexp_extract(text, '^([^:]+):', 1) END AS label FROM lines WHERE regexp_matches(text, '^(•|Languages|Thai|GPA|Date of Birth)')),
 c AS (SELECT *, sum(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) OVER w AS n, first_value(label IS NOT NULL) OVER w AS f FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_index))
 SELECT doc_id, line_index, CAST(n - CASE WHEN f THEN 1 ELSE 0 END AS INT) AS "group", label FROM c""")
def skill_group_numbers(spark, sf_dir):
    li = _lines(spark, sf_dir).where(F.col("text").rlike(r"^(•|Languages|Thai|GPA|Date of Birth)"))
    full = li.withColumns({"heading_no": F.lit(0), "bullet": F.col("text").rlike(P.BULLET), "subheading": F.lit(False), "row_size": F.lit(2), "row_pos": F.lit(0), "left_label": F.lit(False)})
    return X.skill_groups(full).select("doc_id", "line_index", "group", "label")


@query(f"""WITH RECURSIVE {LINES}, o AS (SELECT doc_id, line_index, bold AND NOT regexp_matches(text, '\\d{{4}}') AS title, regexp_matches(text, '\\b(19|20)\\d{{2}}\\b') AS dated, NOT bold AS content, line_index % 2 = 1 AS near FROM lines),
 f AS (SELECT doc_id, line_index, CASE WHEN title OR dated OR content THEN 0 ELSE -1 END AS record, title AND NOT dated AND NOT content AS bare FROM o WHERE line_index = 0
  UNION ALL SELECT o.doc_id, o.line_index, CASE WHEN (o.title AND NOT (f.record >= 0 AND f.bare AND o.near)) OR (NOT o.title AND f.record < 0 AND (o.dated OR o.content)) THEN f.record + 1 ELSE f.record END,
   CASE WHEN o.title THEN CASE WHEN NOT (f.record >= 0 AND f.bare AND o.near) THEN true ELSE f.bare END ELSE f.bare AND NOT (f.record < 0 AND (o.dated OR o.content)) END AND NOT o.dated AND NOT o.content FROM f JOIN o ON o.doc_id = f.doc_id AND o.line_index = f.line_index + 1)
 SELECT doc_id, line_index, record FROM f""")
def grouped_records(spark, sf_dir):
    t = F.col("text")
    rows = _lines(spark, sf_dir).select("doc_id", F.lit(0).alias("heading_no"), F.col("line_index").alias("row"), (F.col("bold") & ~t.rlike(r"\d{4}")).alias("title"), F.lit(False).alias("may_open"), t.rlike(P.YEAR).alias("dated"), (~F.col("bold")).alias("content"), (F.col("line_index") % 2 == 1).alias("near"))
    return X.grouped_roles(rows).select("doc_id", F.col("row").alias("line_index"), "record")


_EVIDENCE = """ev AS (SELECT l_orderkey AS doc_id, 0 AS line_index, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS seg, CASE WHEN l_partkey % 3 = 0 THEN 'A, B' ELSE 'A' END AS text,
 l_partkey % 4 = 0 AS title, l_discount AS confidence, l_suppkey % 3 = 0 AS org, l_suppkey % 5 = 0 AS loc, l_partkey % 11 = 0 AS marker, l_suppkey % 7 = 0 AS link FROM lineitem)"""


@query(f"""WITH {_EVIDENCE}, c AS (SELECT *, count(*) OVER w > 1 AS many, sum(CAST(title AS INT)) OVER w - CAST(title AS INT) AS others FROM ev WINDOW w AS (PARTITION BY doc_id)), d AS (SELECT *, marker OR (many AND link) OR (many AND org AND others > 0) AS company FROM c),
 p AS (SELECT *, title AND NOT company AND row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN title AND NOT company THEN 0 ELSE 1 END, confidence DESC, seg) = 1 AS prim FROM d), q AS (SELECT *, bool_or(prim) OVER (PARTITION BY doc_id) AS has FROM p)
 SELECT doc_id, seg, CASE WHEN prim THEN 'job_title' WHEN org AND loc AND text LIKE '%,%' THEN 'company_location' WHEN company OR (org AND (NOT title OR has)) THEN 'company' WHEN loc AND text LIKE '%,%' THEN 'location' WHEN title THEN 'job_title' ELSE 'unresolved' END AS role FROM q""")
def segment_roles(spark, sf_dir):
    ev = spark.sql("WITH " + _EVIDENCE.replace("FROM lineitem", "FROM {li}") + " SELECT * FROM ev", li=_table(spark, sf_dir, "lineitem"))
    return X.reconcile_segments(ev).select("doc_id", "seg", "role")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_index, unnest(range(len(p))) AS seg, lower(unnest(p)) AS a FROM (SELECT doc_id, line_index, string_split(text, ' | ') AS p FROM lines WHERE text LIKE 'https%') x),
 u AS (SELECT doc_id, line_index, lower(regexp_extract(text, 'https://[^ ]+')) AS b FROM lines WHERE text LIKE 'https%') SELECT doc_id, line_index, CAST(seg AS INT) AS seg, 0 AS url_no FROM s JOIN u USING (doc_id, line_index) WHERE contains(a, b) OR contains(b, a)""")
def urls_of_segments(spark, sf_dir):
    li = _lines(spark, sf_dir).where(F.col("text").startswith("https"))
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    seg = li.select("doc_id", "line_index", F.posexplode(F.split("text", r" \| ")).alias("seg", "text")).withColumn("bbox", none)
    url = li.select("doc_id", "line_index", F.lit(0).alias("url_no"), F.regexp_extract("text", "https://[^ ]+", 0).alias("text"), none.alias("bbox"))
    return X.segment_urls(seg, url)


@query(f"""WITH {LINES}, {_HEADINGS} SELECT doc_id, line_index AS heading_no, section_type FROM hd QUALIFY row_number() OVER (PARTITION BY doc_id, section_type ORDER BY line_index) = 1""")
def first_sections(spark, sf_dir):
    h = _headings(_lines(spark, sf_dir)).select("doc_id", F.col("line_index").alias("heading_no"), "section_type")
    return X.first_of_type(h)


@query(f"""WITH {LINES} SELECT doc_id, line_index, regexp_replace(regexp_replace(text, '\\b(?:19|20)\\d{{2}}\\b', ''), '\\s+', ' ', 'g') AS rest FROM lines WHERE text LIKE 'Bachelor%' OR text LIKE 'Date of%'""")
def lines_without_dates(spark, sf_dir):
    t = F.col("text")
    li = _lines(spark, sf_dir).where(t.startswith("Bachelor") | t.startswith("Date of"))
    return li.select("doc_id", "line_index", F.regexp_replace(X.residual_text(t, C.date_spans(t)), r"\s+", " ").alias("rest"))


@query(f"""WITH RECURSIVE {LINES}, {_BODY}, bl AS (SELECT *, {_BULLETED('text')} AS bullet FROM body), ct AS (SELECT *, CASE WHEN bullet THEN {_MARKER('text')} ELSE text END AS bare, CASE WHEN bullet THEN 'bullet' WHEN subheading THEN 'subheading' ELSE 'paragraph' END AS kind FROM bl),
 kept AS (SELECT * FROM ct WHERE NOT bullet OR bare <> ''), {_BRACKETS.format(keys='doc_id, heading_no', text='bare', rows='kept')},
 f AS (SELECT doc_id, heading_no, n, line_index, page, bare, x0, x1, y1, total - least(0, low) AS depth, 0 AS since, 0 AS block, kind, kind AS first_kind FROM br WHERE n = 1
  UNION ALL SELECT doc_id, heading_no, n, line_index, page, bare, x0, x1, y1, CASE WHEN go THEN {_DEPTH.format(d='depth').replace('o.', '')} ELSE total - least(0, low) END, CASE WHEN go THEN {_SINCE.format(d='depth', s='since').replace('o.', '')} ELSE 0 END, CASE WHEN go THEN block ELSE block + 1 END, kind, CASE WHEN go THEN first_kind ELSE kind END
   FROM (SELECT o.doc_id, o.heading_no, o.n, o.line_index, o.page, o.bare, o.x0, o.x1, o.y1, o.total, o.low, o.kind, f.depth, f.since, f.block, f.first_kind, o.kind = 'paragraph' AND f.first_kind <> 'subheading' AND {_ON.format(gap='5')} AS go FROM f JOIN br o ON o.doc_id = f.doc_id AND o.heading_no = f.heading_no AND o.n = f.n + 1) j)
 SELECT doc_id, heading_no, block, arg_min(first_kind, line_index) AS kind, string_agg(bare, chr(10) ORDER BY line_index) AS text, min(page) AS page FROM f GROUP BY doc_id, heading_no, block""")
def section_blocks(spark, sf_dir):
    li = _lines(spark, sf_dir)
    body = resume.body_lines(li, R.routed_headings(li, _headings(li)), _widths(li)).withColumns({"bullet": F.col("text").rlike(P.BULLET), "paragraph_gap": F.lit(5.0), "line_height": F.lit(10.0)})
    return X.content_blocks(body, ["doc_id", "heading_no"])


# -- header ---------------------------------------------------------------

_FOUND = """fo AS (SELECT doc_id, line_index, CASE WHEN line_index % 3 = 0 THEN 'name' WHEN line_index % 3 = 1 THEN 'location' ELSE 'nationality' END AS kind, 0 AS start, CAST(least(6, length(text)) AS INT) AS stop, substr(text, 1, 6) AS text, CAST(line_index % 5 AS DOUBLE) / 5 AS confidence FROM lines)"""


def _found(spark, sf_dir):
    li = _lines(spark, sf_dir)
    k = F.col("line_index") % 3
    return li, li.select("doc_id", "line_index", F.when(k == 0, "name").when(k == 1, "location").otherwise("nationality").alias("kind"), F.lit(0).alias("start"), F.least(F.lit(6), F.length("text")).alias("end"), F.substring("text", 1, 6).alias("text"), ((F.col("line_index") % 5) / 5).alias("confidence"))


@query(f"""WITH {LINES}, {_FOUND} SELECT doc_id, arg_max(fo.line_index, (l.size, confidence, -fo.line_index)) AS line_index, arg_max(fo.text, (l.size, confidence, -fo.line_index)) AS name FROM fo JOIN lines l USING (doc_id, line_index) WHERE kind = 'name' GROUP BY doc_id""")
def header_names(spark, sf_dir):
    li, found = _found(spark, sf_dir)
    return H.best_name(found, li).select("doc_id", "line_index", F.col("text").alias("name"))


@query(f"""WITH {LINES}, {_FOUND}, e AS (SELECT fo.*, l.text AS line, trim(split_part(l.text, '|', 1), ' ,;:-') AS seg FROM fo JOIN lines l USING (doc_id, line_index) WHERE kind = 'location'),
 g AS (SELECT doc_id, line_index, confidence, CASE WHEN regexp_matches(seg, '^[^\\d@]{{2,48}},\\s*[^\\d@]{{2,48}}$') THEN seg ELSE text END AS t FROM e) SELECT doc_id, arg_max(line_index, (regexp_matches(t, '^[^\\d@]{{2,48}},\\s*[^\\d@]{{2,48}}$'), -line_index)) AS line_index, arg_max(t, (regexp_matches(t, '^[^\\d@]{{2,48}},\\s*[^\\d@]{{2,48}}$'), -line_index)) AS place FROM g GROUP BY doc_id""")
def header_locations(spark, sf_dir):
    li, found = _found(spark, sf_dir)
    return H.best_location(H.expanded(found.where("kind = 'location'"), li)).select("doc_id", "line_index", F.col("text").alias("place"))


@query(f"""WITH {LINES}, f AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_index) <= 5), c AS (SELECT * FROM f WHERE text NOT LIKE '%@mail%' AND {WORDS('text')} BETWEEN 1 AND 6 AND regexp_matches(text, '[A-Za-z]'))
 SELECT doc_id, arg_max(line_index, (size, bold, -line_index)) AS line_index FROM c GROUP BY doc_id""")
def fallback_names(spark, sf_dir):
    li = _lines(spark, sf_dir)
    return H.fallback_name(li, li.where(F.col("text").contains("@mail"))).select("doc_id", "line_index")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_index, trim(unnest(string_split(text, ' | ')), ' ,;:-') AS seg FROM lines), m AS (SELECT * FROM s WHERE regexp_matches(seg, '^[^\\d@]{{2,48}},\\s*[^\\d@]{{2,48}}$')) SELECT doc_id, min(line_index) AS line_index, arg_min(seg, line_index) AS place FROM m GROUP BY doc_id""")
def fallback_locations(spark, sf_dir):
    li = _lines(spark, sf_dir)
    return H.fallback_location(li).select("doc_id", "line_index", F.col("text").alias("place"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, line_index, regexp_extract(text, '(?i)\\b(?:citizenship|nationality)\\s*:\\s*[A-Za-z][A-Za-z]*') AS t FROM lines WHERE text LIKE '%Nationality%') SELECT doc_id, min(line_index) AS line_index, arg_min(t, line_index) AS stated FROM m GROUP BY doc_id""")
def fallback_nationalities(spark, sf_dir):
    n = H.fallback_nationality(_lines(spark, sf_dir).withColumn("text", F.translate("text", "_", " ")))
    return n.select("doc_id", "line_index", F.col("text").alias("stated"))


@query("""WITH l AS (SELECT o_custkey AS doc_id, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b c' WHEN 2 THEN 'd e f g' WHEN 3 THEN 'h i j k l m' ELSE 'n' END AS label, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 1 END AS w FROM orders)
 SELECT a.doc_id, a.o_orderkey, count(b.o_orderkey) AS like_rows FROM l a LEFT JOIN l b ON a.doc_id = b.doc_id AND a.label <> b.label AND abs(a.w - b.w) <= 2 GROUP BY ALL""")
def repeated_labels(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    lab = F.when(k == 0, "a").when(k == 1, "b c").when(k == 2, "d e f g").when(k == 3, "h i j k l m").otherwise("n")
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", lab.alias("label"))
    return H.like_labels(o, ["doc_id"]).select("doc_id", "o_orderkey", "like_rows")


@query(f"""WITH {GLYPHS}, r AS (SELECT doc_id, line_no, tok_no, sum(length(text)) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no) AS d, sum(length(text)) OVER (PARTITION BY doc_id, line_no) AS n FROM glyphs) SELECT doc_id, line_no, tok_no, round(10 + 90.0 * (d - 1) / n, 6) AS x0, round(10 + 90.0 * d / n, 6) AS x1 FROM r""")
def run_slices(spark, sf_dir):
    g = frame(spark, sf_dir, "glyphs").select("doc_id", "line_no", F.col("tok_no").alias("run_no"), "text", F.lit(10.0).alias("left"), F.lit(100.0).alias("right"))
    return H.run_boxes(g).select("doc_id", "line_no", F.col("run_no").alias("tok_no"), F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query(f"""WITH {LINES} SELECT doc_id, line_index, CAST(instr(text, 'Analyst') - 1 AS INT) AS start, CAST(instr(text, '@') AS INT) AS stop FROM lines WHERE text LIKE '%Analyst @%'""")
def link_words(spark, sf_dir):
    a = _lines(spark, sf_dir).select("doc_id", "line_index", H.aligned_words(F.col("text"), F.array(F.lit("ANALYST"), F.lit(" "), F.lit("@"))).alias("a")).where("a is not null")
    return a.select("doc_id", "line_index", F.col("a.start").alias("start"), F.col("a.end").alias("stop"))


@query(f"""WITH {LINES} SELECT doc_id, line_index, CASE WHEN text LIKE '%@mail%' THEN '' ELSE text END AS masked FROM lines""")
def lines_for_models(spark, sf_dir):
    li = _lines(spark, sf_dir)
    claims = C.pattern_claims(li, P.EMAIL, "email").unionByName(C.pattern_claims(li.where(F.col("text").contains("@mail")), P.PHONE, "phone"))
    m = H.masked_lines(li, claims)
    return m.select("doc_id", "line_index", F.when(F.col("text").contains("@mail"), F.btrim("masked", F.lit(" |"))).otherwise(F.col("masked")).alias("masked"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line_index, text FROM lines WHERE text LIKE '%Analyst%' OR text LIKE 'Bachelor%') SELECT doc_id, line_index, CAST(instr(text, 'Analyst') - 1 AS INT) AS start FROM s WHERE text LIKE '%Analyst%'""")
def literal_titles(spark, sf_dir):
    return V.phrase_titles(_lines(spark, sf_dir), ["Analyst", "Senior Analyst"]).select("doc_id", "line_index", "start")


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_index, list_filter(list_transform(regexp_split_to_array(text, '[|•·]|\\s+/\\s+'), lambda x: trim(x, ' ,;:-')), lambda x: x <> '' AND regexp_matches(x, '\\p{{L}}') AND len(string_split(regexp_replace(x, '\\s+', ' ', 'g'), ' ')) <= 10)[1:3] AS s FROM lines) SELECT doc_id, line_index, array_to_string(s, ' / ') AS segments FROM p""")
def title_candidates(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_index", F.array_join(V.title_segments(F.col("text")), " / ").alias("segments"))


# -- vectors ---------------------------------------------------------------

_DOT = "round(max(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))), 4)"


def _vectors(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    refs = e.where("vec_id < 20").select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("class"), F.col("vec_id").cast("int").alias("ord"), F.col("embedding").alias("vector"))
    return e.where("vec_id >= 20").select("vec_id", F.col("embedding").alias("vector")), refs


@query(f"""WITH s AS (SELECT c.vec_id, 'c' || CAST(r.label AS STRING) AS class, {_DOT} AS score, min(r.vec_id) AS ord FROM embeddings c, embeddings r WHERE r.vec_id < 20 AND c.vec_id >= 20 GROUP BY c.vec_id, r.label),
 k AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, ord)) SELECT vec_id, class, score, runner_up FROM k WHERE n = 1""")
def nearest_classes(spark, sf_dir):
    cand, refs = _vectors(spark, sf_dir)
    scores = V.class_scores(cand, refs, ["vec_id"]).withColumn("score", F.round("score", 4))
    return V.winners(scores, ["vec_id"])


@query(f"""WITH s AS (SELECT c.vec_id, 'c' || CAST(r.label AS STRING) AS class, max(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))) AS score, min(r.vec_id) AS ord FROM embeddings c, embeddings r WHERE r.vec_id < 20 AND c.vec_id >= 20 GROUP BY c.vec_id, r.label),
 k AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, ord)) SELECT vec_id, class, round(score, 4) AS score FROM k WHERE n = 1 AND score >= 0.25 AND score - runner_up >= 0.02""")
def accepted_classes(spark, sf_dir):
    cand, refs = _vectors(spark, sf_dir)
    return V.classify(cand, refs, ["vec_id"], 0.25, 0.02).select("vec_id", "class", F.round("score", 4).alias("score"))


@query("""WITH s AS (SELECT c.vec_id, max(CASE WHEN r.vec_id < 12 THEN list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) END) AS confidence, max(CASE WHEN r.vec_id >= 12 THEN list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) END) AS against FROM embeddings c, embeddings r WHERE r.vec_id < 20 AND c.vec_id >= 20 GROUP BY c.vec_id)
 SELECT vec_id, round(confidence, 4) AS confidence, round(against, 4) AS against FROM s WHERE confidence - against >= 0.06""")
def titles_against_others(spark, sf_dir):
    cand, refs = _vectors(spark, sf_dir)
    t = V.title_scores(cand, refs.where("ord < 12"), refs.where("ord >= 12"), ["vec_id"])
    return t.where(F.col("confidence") - F.col("against") >= P.TITLE_MARGIN).select("vec_id", F.round("confidence", 4).alias("confidence"), F.round("against", 4).alias("against"))


_TAGS = """tk AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS tok_no, CASE event_id % 7 WHEN 0 THEN 'B-ORG' WHEN 1 THEN 'I-ORG' WHEN 2 THEN 'LOC' WHEN 3 THEN 'B-LOC' WHEN 4 THEN 'I-LOC' ELSE 'O' END AS tag, value / 200 AS score FROM events)"""


@query(f"""WITH {_TAGS}, l AS (SELECT *, CASE WHEN tag <> 'O' THEN regexp_replace(tag, '^[BI]-', '') END AS label FROM tk), b AS (SELECT *, CASE WHEN label IS NULL OR tag LIKE 'B-%' OR coalesce(lag(label) OVER w <> label, true) THEN 1 ELSE 0 END AS o FROM l WINDOW w AS (PARTITION BY user_id ORDER BY tok_no)),
 r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY tok_no) AS run FROM b) SELECT user_id, label, min(tok_no * 10) AS start, max(tok_no * 10 + 7) AS stop, round(avg(score), 6) AS score FROM r WHERE label IS NOT NULL GROUP BY user_id, run, label""")
def token_entities(spark, sf_dir):
    t = spark.sql("WITH " + _TAGS.replace("FROM events", "FROM {e}") + " SELECT * FROM tk", e=_table(spark, sf_dir, "events")).withColumns({"start": F.col("tok_no") * 10, "end": F.col("tok_no") * 10 + 7})
    return V.entity_groups(t, ["user_id"]).select("user_id", "label", "start", F.col("end").alias("stop"), F.round("score", 6).alias("score"))


@query(f"""WITH {_TAGS}, e AS (SELECT user_id, tok_no * 10 AS s, tok_no * 10 + 8 AS e, CASE WHEN tok_no % 3 = 0 THEN 'X' ELSE 'Y' END AS label, score FROM tk WHERE score >= 0.2),
 b AS (SELECT *, CASE WHEN lag(label) OVER w = label AND s - lag(e) OVER w <= 3 THEN 0 ELSE 1 END AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, e)), r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, e) AS run FROM b)
 SELECT user_id, label, min(s) AS start, max(e) AS stop, round(min(score), 6) AS score FROM r GROUP BY user_id, run, label""")
def merged_spans(spark, sf_dir):
    t = spark.sql("WITH " + _TAGS.replace("FROM events", "FROM {e}") + " SELECT * FROM tk", e=_table(spark, sf_dir, "events"))
    e = t.select("user_id", (F.col("tok_no") * 10).alias("start"), (F.col("tok_no") * 10 + 8).alias("end"), F.when(F.col("tok_no") % 3 == 0, "X").otherwise("Y").alias("label"), "score")
    texts = t.groupBy("user_id").agg(F.repeat(F.lit(" "), F.max("tok_no") * 10 + 10).alias("text"))
    return V.merged_entities(e, texts, ["user_id"], 0.2).select("user_id", "label", "start", F.col("end").alias("stop"), F.round("score", 6).alias("score"))


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS tag_no, round(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 5) AS score FROM embeddings""")
def softmax_tags(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"))
    return V.argmax_tags(e).select("vec_id", F.col("tag_no").cast("int").alias("tag_no"), F.round("score", 5).alias("score"))


@query(f"""WITH {LINES} SELECT doc_id, line_index, CASE lower(trim(text)) WHEN 'education' THEN 'education' WHEN 'work experience' THEN 'experience' END AS class FROM lines WHERE lower(trim(text)) IN ('education', 'work experience')""")
def exact_classes(spark, sf_dir):
    li = _lines(spark, sf_dir).select("doc_id", "line_index", "text")
    return V.exact_class(li, R.section_references(spark), "text").where("class is not null").select("doc_id", "line_index", "class")


@query()
def model_headings(spark, sf_dir):
    """Headings by a stand-in model: vectors of trigrams, the thresholds of the real one."""
    li = _lines(spark, sf_dir)
    cand = V.encode(R.heading_candidates(li).select("heading").distinct(), "heading", V.hashed_provider())
    refs = V.encode(R.section_references(spark), "phrase", V.hashed_provider())
    return V.classify(cand, refs, ["heading"], P.HEADING_SIMILARITY, P.HEADING_MARGIN).select("heading", "class", F.round("score", 4).alias("score"))


# -- evaluation ---------------------------------------------------------------

_RULE = "CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END"


@query(f"""WITH c AS (SELECT source, CAST(sum(CASE WHEN quality = 1 AND {_RULE} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN quality = 0 AND {_RULE} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN quality = 1 AND {_RULE} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY source)
 SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE CASE WHEN fp = 0 OR fn = 0 THEN 0 ELSE 0 END END, 6) AS f1 FROM c""")
def rule_scores(spark, sf_dir):
    j = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    hit, good = F.col("n_chars") >= 500, F.col("quality") == 1
    c = j.select("source", (hit & good).cast("int").alias("tp"), (hit & ~good).cast("int").alias("fp"), (~hit & good).cast("int").alias("fn"))
    return E.scores(c, ["source"]).withColumns({m: F.round(m, 6) for m in ("precision", "recall", "f1")})


@query(f"""WITH c AS (SELECT source, sum(CASE WHEN quality = 1 AND {_RULE} = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 AND {_RULE} = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 1 AND {_RULE} = 0 THEN 1 ELSE 0 END) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY source)
 SELECT round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1, count(*) AS fields FROM c""")
def macro_score(spark, sf_dir):
    j = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    hit, good = F.col("n_chars") >= 500, F.col("quality") == 1
    c = j.select("source", (hit & good).cast("int").alias("tp"), (hit & ~good).cast("int").alias("fp"), (~hit & good).cast("int").alias("fn"))
    return E.macro(E.scores(c, ["source"])).select(F.round("macro_f1", 6).alias("macro_f1"), "fields")


@query("""WITH c AS (SELECT source, sum(CASE WHEN quality = 1 AND n_chars >= 500 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 AND n_chars >= 500 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 1 AND n_chars < 500 THEN 1 ELSE 0 END) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY source),
 s AS (SELECT source, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c) SELECT source AS field, round(f1 + CASE WHEN length(source) % 2 = 0 THEN 0.01 ELSE -0.01 END, 6) AS floor, round(f1, 6) AS f1 FROM s WHERE length(source) % 2 = 0""")
def score_regressions(spark, sf_dir):
    """Sources whose score is below a floor set above every second one."""
    j = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    hit, good = F.col("n_chars") >= 500, F.col("quality") == 1
    now = E.scores(j.select("source", (hit & good).cast("int").alias("tp"), (hit & ~good).cast("int").alias("fp"), (~hit & good).cast("int").alias("fn")), ["source"]).select(F.col("source").alias("field"), "f1")
    floor = now.select("field", (F.col("f1") + F.when(F.length("field") % 2 == 0, 0.01).otherwise(-0.01)).alias("f1"))
    return E.regressions(now, floor).select("field", F.round("floor", 6).alias("floor"), F.round("f1", 6).alias("f1"))


@query("""WITH w AS (SELECT l_orderkey AS doc_id, list(DISTINCT 'v' || CAST(l_partkey % 9 AS STRING)) AS want, list(DISTINCT 'v' || CAST(l_suppkey % 9 AS STRING)) AS got FROM lineitem GROUP BY l_orderkey)
 SELECT doc_id, len(list_intersect(want, got)) AS tp, len(got) - len(list_intersect(want, got)) AS fp, len(want) - len(list_intersect(want, got)) AS fn FROM w""")
def matched_values(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    side = lambda c: li.select(F.col("l_orderkey").alias("doc_id"), F.lit("f").alias("field"), F.concat(F.lit("v"), (F.col(c) % 9).cast("string")).alias("value")).distinct().withColumn("seq", F.col("value"))
    c = E.field_counts(side("l_partkey"), side("l_suppkey"))
    return c.select("doc_id", *[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn")])


@query("""SELECT c_custkey, lower(trim(regexp_replace('  ' || c_name || ' – ' || c_mktsegment || ' .', '\\s+', ' ', 'g'), ' .')) AS x FROM customer""".replace("AS x", "AS x0").replace("SELECT c_custkey, lower", "SELECT c_custkey, replace(lower").replace(" AS x0", ", '–', '-') AS folded"))
def normal_values(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", E.normal(F.concat(F.lit("  "), "c_name", F.lit(" – "), "c_mktsegment", F.lit(" ."))).alias("folded"))


# -- sources and sinks ---------------------------------------------------------------


@query("""WITH w AS (SELECT l_orderkey - l_orderkey % 40 AS doc_id, 1 + l_linenumber % 2 AS page, l_linenumber AS line_num, 'w' || CAST(l_partkey % 50 AS STRING) AS text, (l_quantity * 72.0 / 300) AS h, CASE WHEN l_suppkey % 9 = 0 THEN -1.0 ELSE l_tax * 1000 END AS conf, l_extendedprice / 100 AS x, row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS word_num FROM lineitem WHERE l_partkey % 50 <> 0)
 SELECT doc_id, page, line_num, string_agg(text, ' ' ORDER BY word_num) AS text, round(median(h), 6) AS size, round(avg(CASE WHEN conf >= 0 THEN conf END), 4) AS confidence FROM w GROUP BY doc_id, page, line_num""")
def ocr_lines(spark, sf_dir):
    tsv = spark.sql("SELECT l_orderkey - l_orderkey % 40 AS doc_id, 5 AS level, 1 + l_linenumber % 2 AS page_num, 0 AS block_num, 0 AS par_num, l_linenumber AS line_num, CAST(row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS word_num, l_extendedprice / 100 AS left, 10D AS top, 5D AS width, l_quantity AS height, CASE WHEN l_suppkey % 9 = 0 THEN -1D ELSE l_tax * 1000 END AS conf, CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE concat('w', l_partkey % 50) END AS text FROM {li}", li=_table(spark, sf_dir, "lineitem"))
    return ocr.lines(ocr.words(tsv)).select("doc_id", "page", "line_num", "text", F.round("size", 6).alias("size"), F.round("confidence", 4).alias("confidence"))


@query(f"""SELECT doc_id, {ALNUM('text')} < 20 AS needs_ocr FROM documents""")
def ocr_gate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", ocr.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax * 100 <= 2 AND l_quantity >= 10 THEN 'horizontal' WHEN l_quantity <= 2 AND l_tax * 100 >= 10 THEN 'vertical' END AS kind FROM lineitem""")
def rule_kinds(spark, sf_dir):
    k = physical.rule_kind(F.col("l_quantity"), F.col("l_tax") * 100)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", k.alias("kind"))


@query("""WITH i AS (SELECT p_partkey, 100 + p_partkey % 900 AS w, 100 + p_size * 20 AS h, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 180 WHEN 2 THEN 270 ELSE 90 END AS rotation FROM part)
 SELECT p_partkey, rotation, round(CASE WHEN rotation IN (90, 270) THEN h ELSE w END * 842.0 / greatest(w, h), 4) AS width, round(CASE WHEN rotation IN (90, 270) THEN w ELSE h END * 842.0 / greatest(w, h), 4) AS height FROM i""")
def image_pages(spark, sf_dir):
    k = F.col("p_partkey")
    tag = F.when(k % 4 == 0, 2).when(k % 4 == 1, 3).when(k % 4 == 2, 6).otherwise(8)
    im = _table(spark, sf_dir, "part").select(k.alias("path"), (100 + k % 900).alias("pixel_width"), (100 + F.col("p_size") * 20).alias("pixel_height"), tag.alias("tag"))
    return images.pages(im).select(F.col("path").alias("p_partkey"), "rotation", F.round("width", 4).alias("width"), F.round("height", 4).alias("height"))


@query("""WITH f AS (SELECT c_custkey, '/in/' || c_name || CASE c_custkey % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.txt' ELSE '' END AS path FROM customer)
 SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' END AS reader, CASE WHEN c_custkey % 2 = 0 THEN '/out/' || regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') || '.json' ELSE '/out/x.json' END AS output, CASE WHEN c_custkey % 2 = 0 THEN '/out/' || regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') ELSE '/out/x' END AS artifacts FROM f""")
def document_paths(spark, sf_dir):
    k = F.col("c_custkey")
    f = _table(spark, sf_dir, "customer").select(k, F.concat(F.lit("/in/"), "c_name", F.when(k % 5 == 0, ".docx").when(k % 5 == 1, ".PDF").when(k % 5 == 2, ".jpeg").when(k % 5 == 3, ".txt").otherwise("")).alias("path"))
    out = corpus.output_path(F.col("path"), F.when(k % 2 == 0, F.lit("/out/")).otherwise(F.lit("/out/x.json")))
    return f.select("c_custkey", corpus.reader_of(F.col("path")).alias("reader"), out.alias("output"), corpus.artifact_folder(out).alias("artifacts"))


@query("""SELECT doc_id, sha256(text) = sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS ok FROM documents""")
def verified_files(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    other = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    want = d.select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.encode(other, "UTF-8"), 256).alias("sha256"))
    return corpus.same_file(files, want).select(F.col("path").alias("doc_id"), "ok")


def _resumes(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"))
    entry = F.struct(F.array(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))).alias("subheadings"), F.array(F.year("o_orderdate").cast("string")).alias("dates"), F.expr("cast(array() as array<struct<text:string,url:string>>)").alias("urls"), F.array("o_orderpriority").alias("paragraphs"), F.expr("cast(array() as array<string>)").alias("bullets"))
    projects = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]).alias("projects"))
    return output.resumes(docs, [projects])


@query("""SELECT c_custkey AS doc_id, '1.0' AS version, o.n AS projects, true AS conforms, '' AS leaked FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS INT) AS n FROM orders GROUP BY ALL) o ON o_custkey = c_custkey""")
def resume_records(spark, sf_dir):
    r = _resumes(spark, sf_dir).withColumn("json", output.as_json(F.col("resume")))
    size = F.when(F.col("resume.projects").isNotNull(), F.size("resume.projects"))
    return r.select("doc_id", F.get_json_object("json", "$.schema_version").alias("version"), size.alias("projects"), output.conforms(F.col("json")).alias("conforms"), F.array_join(output.leaked(F.col("json")), ",").alias("leaked"))


@query("""WITH e AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS entry, o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
 SELECT doc_id, 'projects' AS section, entry, 0 AS ord, 'title' AS style, 'Order ' || CAST(o_orderkey AS STRING) AS text FROM e UNION ALL SELECT doc_id, 'projects', entry, 1, 'meta', CAST(year(o_orderdate) AS STRING) FROM e UNION ALL SELECT doc_id, 'projects', entry, 2, 'paragraph', o_orderpriority FROM e""")
def resume_blocks(spark, sf_dir):
    return output.blocks(_resumes(spark, sf_dir))


@query(f"""WITH {BOXES} SELECT doc_id, page, CASE WHEN bold THEN 'title' ELSE 'text' END AS label, count(*) AS n, min(CASE WHEN line_no % 2 = 0 THEN 1 ELSE 2 END) AS thinnest FROM boxes WHERE x1 > x0 AND y1 > y0 GROUP BY ALL""")
def legend_counts(spark, sf_dir):
    ev = _boxes(spark, sf_dir).select("doc_id", "page", "bbox", F.when(F.col("bold"), "title").otherwise("text").alias("label"), F.when(F.col("line_no") % 2 == 0, "distilbert_ner").otherwise("regex").alias("method"))
    boxes = output.box_table(ev)
    return output.legend(boxes).join(boxes.groupBy("doc_id", "page", "label").agg(F.min("stroke").alias("thinnest")), ["doc_id", "page", "label"])


_WARNINGS = " UNION ALL ".join(f"SELECT doc_id, page, '{kind}' AS kind FROM ({ORACLES[name]}) {kind}" for kind, name in (("multiple_columns", "column_gutters"), ("vertical_text", "turned_text"), ("overlapping_text", "text_over_text"), ("text_in_graphics", "text_in_images"), ("nested_table", "nested_rules")))


def _warnings(spark, sf_dir):
    """Every reason why a page's order may be a guess, from the relations that the detectors' queries use.

    The boxes are numbered and brought together by page once; all detectors read that."""
    line = F.struct("line_no", "text", "bbox", "dir_x", "dir_y")
    pages = staged(_boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.collect_list(line).alias("lines")), "pages")
    b = pages.select("doc_id", "page", F.inline("lines")).select("*", "bbox.*")
    gutters = ST.page_gutters(pages.select("doc_id", "page", F.col("lines.bbox").alias("boxes")), _widths(pages))
    return b, L.unsupported_layouts(b, _pages(b), _image_boxes(b), _rule_boxes(b), gutters, L.page_overlaps(pages))


@query(_WARNINGS)
def layout_warnings(spark, sf_dir):
    return _warnings(spark, sf_dir)[1].select("doc_id", "page", "kind")


@query(f"WITH w AS ({_WARNINGS}), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), {BOXES} SELECT d.doc_id, n IS NULL AS supported, coalesce(n, 0) AS warnings FROM (SELECT DISTINCT doc_id FROM boxes) d LEFT JOIN n USING (doc_id)")
def layout_report(spark, sf_dir):
    b, w = _warnings(spark, sf_dir)
    return output.warnings_report(b.select("doc_id").distinct(), w).select("doc_id", "supported", F.size("warnings").cast("long").alias("warnings"))


@query()
def extracted_resumes(spark, sf_dir):
    """The whole plan from lines to JSON."""
    li = _lines(spark, sf_dir)
    return resume.resumes(li, _widths(li)).select("doc_id", output.as_json(F.col("resume")).alias("json"))


@query("""WITH n AS (SELECT c_custkey, c_custkey % 2 = 0 AS even, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer), c AS (SELECT count(*) FILTER (even AND has) AS tp, count(*) FILTER (NOT even AND has) AS fp, count(*) FILTER (NOT even OR NOT has) AS fn FROM n)
SELECT 'section_routing' AS field, tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def section_routing_scores(spark, sf_dir):
    """Records scored against labels that state projects for every second customer, skills for the others."""
    results = _resumes(spark, sf_dir).select("doc_id", output.as_json(F.col("resume")).alias("json"))
    stated = F.when(F.col("doc_id") % 2 == 0, '{"sections_present": ["projects"]}').otherwise('{"sections_present": ["skills"]}')
    return E.scorecard(results.select("doc_id", stated.alias("json")), results).withColumns({m: F.round(m, 6) for m in ("precision", "recall", "f1")})


# the flagship: contacts of documents, in order of precedence, as JSON with nulls kept
@query(f"""WITH {DOC_LINES}, e AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT m, ',' ORDER BY m) AS found FROM (SELECT DISTINCT doc_id, line_index, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_.+-]+@[\\p{{L}}\\p{{N}}_.-]+\\.[A-Za-z]{{2,}}')) AS m FROM dl) x GROUP BY ALL)
 SELECT d.doc_id, CAST(coalesce(n, 0) AS INT) AS emails, coalesce(found, '') AS found FROM documents d LEFT JOIN e USING (doc_id)""")
def document_contacts(spark, sf_dir):
    """Addresses of documents: how many, one that stands twice in a line counted once, and which."""
    claims = staged(_contact_claims(spark, sf_dir), "contacts")
    emails = F.coalesce(F.col("resume.header_profile.emails"), F.expr("cast(array() as array<string>)"))
    n = claims.where("kind = 'email'").groupBy("doc_id").agg(F.count_distinct("line_index", "text").cast("int").alias("n"))
    found = _profiles(spark, sf_dir, claims).join(n, "doc_id", "left")
    return found.select("doc_id", F.coalesce("n", F.lit(0)).alias("emails"), F.array_join(F.array_sort(F.array_distinct(emails)), ",").alias("found"))


def document_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir, _contact_claims(spark, sf_dir)).select("doc_id", output.as_json(F.col("resume")).alias("json"))


def _contact_claims(spark, sf_dir):
    lines = _doc_lines(spark, sf_dir).where(~T.is_blank(F.col("text")))
    return C.resolve(C.pattern_claims(lines, P.EMAIL, "email", order=1).unionByName(C.pattern_claims(lines, P.PHONE, "phone", order=2)))


def _profiles(spark, sf_dir, claims):
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return output.resumes(docs, [output.header_profile(claims)])
