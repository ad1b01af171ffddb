"""Every document query against its SQL, and without one that it gives rows."""

import math
from collections import Counter

import pytest

from quirewise.plans import queries


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got, "no rows: it would agree with anything"
    if name in queries.ORACLES:
        cursor = duck.execute(queries.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
        assert got == want


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "json"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_address_twice_in_a_line(spark, tmp_path):
    """It counts once for its line, as in the SQL; each of its places is its own."""
    text = "a@b.co and a@b.co\nc@d.org a@b.co"
    spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.document_contacts(spark, str(tmp_path)).collect())
    assert got == [(1, 3, "a@b.co,c@d.org"), (2, 0, "")]
    spans = sorted((r["line_index"], r["start"], r["stop"]) for r in queries.document_emails(spark, str(tmp_path)).collect())
    assert spans == [(0, 0, 6), (0, 11, 17), (1, 0, 7), (1, 8, 14)]
