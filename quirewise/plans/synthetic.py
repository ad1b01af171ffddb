"""Relations of documents made from the star schema by one expression that Spark and DuckDB both run.

The tables hold few lines with the shapes that the operators look for, so lines, boxes, glyphs and claims
are derived from orders and line items; a larger scale has more documents, not longer ones. ``frame`` runs a relation in Spark; ``sql`` gives its text for a CTE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_S = "CAST({} AS STRING)".format
_YEAR = "year(o_orderdate)"

RELATIONS = {
    # lines of a résumé: doc_id, line_index, page, text, size, bold and a box
    "lines": f"""
    SELECT doc_id, line_index, page, text, CAST(size AS DOUBLE) AS size, bold, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + 5.0 * length(text) AS DOUBLE) AS x1, CAST(y0 + size AS DOUBLE) AS y1 FROM (
      SELECT o_custkey AS doc_id, CAST(i AS INT) AS line_index, CAST(1 + (i - i % 6) / 6 AS INT) AS page,
        CASE o_orderkey % 16
          WHEN 0 THEN '• Led ' || c_mktsegment || ' delivery for ' || c_name
          WHEN 1 THEN c_mktsegment || ' Analyst @ ' || c_name || ' Ltd | ' || {_S(_YEAR)} || ' - ' || {_S(_YEAR + ' + 2')}
          WHEN 2 THEN 'Jan ' || {_S(_YEAR)} || ' – Present'
          WHEN 3 THEN 'Bachelor of Science, ' || n_name || ' University, ' || {_S(_YEAR)}
          WHEN 4 THEN 'GPA: 3.' || {_S('o_orderkey % 10')} || '/4.0'
          WHEN 5 THEN 'user' || {_S('o_custkey')} || '@mail.example.com | +66 81 555 ' || {_S('1000 + o_orderkey % 9000')}
          WHEN 6 THEN 'CERTIFICATIONS & LANGUAGES'
          WHEN 7 THEN 'Languages: English, Thai'
          WHEN 8 THEN 'Work Experience'
          WHEN 9 THEN 'https://www.example.com/u/' || {_S('o_custkey')} || ' | ' || n_name || ', Asia'
          WHEN 10 THEN 'Page ' || {_S('o_orderkey')}
          WHEN 11 THEN 'Date of Birth: 12 May ' || {_S(_YEAR)} || ' | Nationality: ' || n_name
          WHEN 12 THEN 'EDUCATION'
          WHEN 13 THEN 'Delivered (with ' || c_mktsegment || ' [and others' || CASE WHEN o_orderkey % 3 = 0 THEN ']) plans.' ELSE '' END
          WHEN 14 THEN '2. Technical Skills'
          ELSE 'Thai: Native' END AS text,
        CASE WHEN o_orderkey % 16 IN (6, 8, 12, 14) THEN 14.0 ELSE 10.0 + o_orderkey % 2 END AS size,
        o_orderkey % 16 IN (8, 12) OR o_orderkey % 7 = 0 AS bold, 40.0 + 18.0 * (o_orderkey % 3) + CASE WHEN i % 6 = 5 THEN 306.0 ELSE 0.0 END AS x0, 40.0 + 15.0 * (CASE WHEN i % 6 = 5 THEN 4 ELSE i % 6 END) + o_orderkey % 2 AS y0
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM [orders]) AS o
      JOIN [customer] AS c ON o_custkey = c_custkey JOIN [nation] AS n ON c_nationkey = n_nationkey) AS t""",
    # boxes of text lines: two columns of them, some turned
    "boxes": """
    SELECT doc_id, page, line_no, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + w AS DOUBLE) AS x1, CAST(y0 + h AS DOUBLE) AS y1, CAST(size AS DOUBLE) AS size, bold, CAST(CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS dir_x, CAST(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS dir_y,
      CASE WHEN k % 5 = 0 THEN 'Report 2024 page ' || CAST(page AS STRING) WHEN k % 13 = 0 THEN ' ' ELSE 'line of ' || CAST(k % 4 AS STRING) || ' words' END AS text
    FROM (SELECT doc_id, CAST(1 + line_no % 3 AS INT) AS page, line_no, k, 40.0 + 250.0 * (k % 2) + (k % 7) AS x0, 30.0 + 12.0 * line_no + (k % 3) - CASE WHEN k % 19 = 0 THEN 33.0 ELSE 0.0 END AS y0, 100.0 + q AS w, 9.0 + k % 4 AS h, 9.0 + k % 4 AS size, k % 3 = 0 AS bold
      FROM (SELECT l_orderkey - l_orderkey % 40 AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS line_no, l_partkey AS k, l_quantity AS q FROM [lineitem]) AS a) AS b""",
    # glyphs of lines, with gaps
    "glyphs": """
    SELECT doc_id, 1 AS page, line_no, CAST(tok_no - tok_no % 5 AS INT) AS span_no, CAST(tok_no AS INT) AS tok_no, CASE WHEN k % 9 = 0 THEN ' ' ELSE chr(CAST(97 + k % 26 AS INT)) END AS text,
      CAST(6.0 * tok_no + 0.5 * (k % 8) AS DOUBLE) AS x0, CAST(6.0 * tok_no + 0.5 * (k % 8) + 5.0 AS DOUBLE) AS x1, CAST(100 AS DOUBLE) AS y0, CAST(110 AS DOUBLE) AS y1, CAST(CASE WHEN k % 17 = 0 THEN 104 ELSE 108 END AS DOUBLE) AS origin_y, CASE WHEN k % 4 = 0 THEN 'B' ELSE 'A' END AS font, CAST(10 AS DOUBLE) AS size, k % 4 = 0 AS bold, CAST(5 AS DOUBLE) AS char_width
    FROM (SELECT l_orderkey - l_orderkey % 48 AS doc_id, CAST(l_orderkey % 48 - l_orderkey % 16 AS INT) AS line_no, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS tok_no FROM [lineitem]) AS a""",
    # claims that overlap on lines
    "claims": """
    SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS line_index, 'k' || CAST(l_suppkey % 3 AS STRING) AS kind, CAST(l_partkey % 60 AS INT) AS start, CAST(l_partkey % 60 + 1 + l_quantity % 20 AS INT) AS "end", 'x' AS text,
      CAST(1 + l_suppkey % 6 AS INT) AS tier, CAST(l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS seq, CASE l_suppkey % 4 WHEN 0 THEN 'regex' WHEN 1 THEN 'geometry_ner_reconstruction' WHEN 2 THEN 'geometry_semantic' ELSE 'job_title_phrase' END AS method
    FROM [lineitem]""",
}
_TABLE = re.compile(r"\[(\w+)\]")


def sql(name: str) -> str:
    """A relation's text for DuckDB."""
    return _TABLE.sub(r"\1", RELATIONS[name])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = RELATIONS[name].replace('"end"', "`end`")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(text))}
    return spark.sql(_TABLE.sub(r"{\1}", text), **tables)
