"""Mixing sources to target weights by iterative proportional fitting.

Everything is DataFrame operations. Token weights are summed into cells of (source, language, topic); the
cells are raked until their margins meet the targets. No document is drawn twice, so the draw is raked again
under the bound that no cell's probability passes 1: a margin that is too small for its share of the draw is
kept whole, and the others of its dimension share what it leaves, in proportion to their targets. Each document
is then drawn by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

DIMS = ("source", "lang", "topic")
#: Up to so many cells are swept in one task, so many sweeps a table.
FEW_CELLS, BLOCK = 100_000, 5
NEARLY = 1 - 1e-9
_U = "cast(conv(substr(md5(cast(coalesce(doc_id, -1) as string)), 1, 13), 16, 10) as double) / 4503599627370496D"


def topic():
    """A stand-in for a topic model: the text's form, from shares of digits, line ends and words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.length(text)
    digits = n - F.length(F.translate(text, "0123456789", ""))
    lines = n - F.length(F.translate(text, "\n", ""))
    return F.when(n == 0, "empty").when(digits * 50 >= n, "numeric").when(lines * 100 >= n, "lines").otherwise("prose")


def tokens():
    """Tokens, estimated as words between spaces and line ends."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("long")


def rake(docs: DataFrame, alpha: float = 0.7, sweeps: int = 10, share: float = 0.8, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows (doc_id, source, lang, topic, tokens, weight, probability, sampled), one for each row of docs.

    A margin's target share is its own share to the power ``alpha``, normalised, unless ``targets`` has a
    table (value, share) for it; a value without a target, or with a share of 0, gets weight 0. ``weight``
    is raked token weight over tokens of the document's cell. ``probability`` is raked from it, at most 1, so
    that the expected tokens are ``share`` of all (of those with a weight, if they are fewer) and each margin
    meets its target as far as it has tokens; a document is sampled if a hash of its id falls below it. Both
    take up to ``sweeps`` sweeps and stop when one moves nothing. Null source, language and text count as ''
    (topic 'empty'); documents without tokens have weight and probability 1 of their own and stay; a null id
    draws as -1; repeated rows draw alike; an empty table gives no rows; clashing columns (topic, tokens,
    weight, ...) of the input are ignored.
    """
    base = materialize(_cells_of(docs), "tokens")  # a few numbers a document: texts are read once
    weights = _fit(base, alpha, sweeps, share, targets)
    # a few numbers a cell against all documents: cells are few, and where they are not Spark shuffles;
    # cells may be hot, so AQE may split the documents' side
    out = base.join(weights, list(DIMS), "left")
    weight = F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("weight", F.lit(0.0)))
    out = out.withColumn("weight", weight).withColumn("probability", F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("probability", F.lit(0.0))))
    return out.select("doc_id", *DIMS, "tokens", "weight", "probability", (F.expr(_U) < F.col("probability")).alias("sampled"))


def _cells_of(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), topic().alias("topic"), tokens().alias("tokens"))


def _fit(base: DataFrame, alpha: float, sweeps: int, part: float, targets: dict | None) -> DataFrame:
    """(source, lang, topic, weight, probability) of every cell with tokens."""
    cells = materialize(base.groupBy(*DIMS).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0"), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    for d in DIMS:  # each cell knows its margins' goals, so that a sweep joins sums only
        margin = cells.groupBy(d).agg(F.sum("n").alias("_own"))
        if targets and d in targets:
            margin = margin.join(targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias("_goal")), d, "left").fillna(0.0, ["_goal"])
        else:
            margin = margin.withColumn("_goal", F.pow("_own", F.lit(alpha)))
        margin = materialize(margin, "margin")
        whole = margin.agg(F.sum("_goal")).first()[0] or 1.0
        margin = margin.select(d, "_own", (F.col("_goal") / F.lit(whole)).alias("_goal"))
        # what the draw can have of each: its goal's share at the factor that makes up the draw, or all it has
        able = margin.where("_goal > 0").agg(F.sum("_own")).first()[0] or 0.0
        scale = _scale(margin.select(F.col("_own").alias("n"), (F.col("_goal") / F.col("_own")).alias("weight")), min(part * total, able))
        take = F.least(F.col("_own"), F.col("_goal") * F.lit(scale))
        cells = cells.join(margin.select(d, F.col("_goal").alias(f"_{d}"), take.alias(f"_take_{d}"), (take >= F.col("_own")).alias(f"_all_{d}")), d)
    kept = [c for d in DIMS for c in (f"_{d}", f"_take_{d}", f"_all_{d}")]
    raked = cells.select(*DIMS, "n", *kept, F.col("n").alias("w"))
    raked = _swept(materialize(raked, "raked"), sweeps, lambda d: F.when(F.col("_have") > 0, F.col("w") * F.col(f"_{d}") * F.lit(total) / F.col("_have")).otherwise(F.lit(0.0)), F.sum("w"))
    raked = raked.withColumn("weight", F.col("w") / F.col("n")).withColumn("w", F.col("w") * F.lit(part))
    # under the bound: w may pass n, but counts for n; rounding must not tell a cell at 1 from one just below
    full = F.col("w") >= F.col("n") * F.lit(NEARLY)

    def bounded(d):
        free = F.when(F.col("_have") > 0, F.greatest(F.col(f"_take_{d}") - F.col("_full"), F.lit(0.0)) / F.col("_have")).otherwise(F.lit(1.0))
        # cells that stand at 1 leave no room: all are scaled down
        factor = F.when((F.col("_full") >= F.col(f"_take_{d}") * F.lit(NEARLY)) & (F.col("_full") > 0), F.col(f"_take_{d}") / (F.col("_full") + F.col("_have"))).otherwise(free)
        return F.when(F.col(f"_all_{d}"), F.when(F.col("w") > 0, F.greatest("w", "n")).otherwise(F.col("w"))).otherwise(F.col("w") * factor)

    raked = _swept(materialize(raked, "raked"), sweeps, bounded, F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.sum(F.when(full, F.col("n")).otherwise(0.0)))
    raked = materialize(raked.select(*DIMS, "n", F.col("weight").alias("_weight"), (F.col("w") / F.col("n")).alias("weight")), "raked")
    able = raked.where("weight > 0").agg(F.sum("n")).first()[0] or 0.0
    scale = _scale(raked, min(part * total, able))
    return raked.select(*DIMS, F.col("_weight").alias("weight"), F.least(F.col("weight") * F.lit(scale), F.lit(1.0)).alias("probability"))


def _swept(cells: DataFrame, sweeps: int, step, have, full=None) -> DataFrame:
    """Cells after up to ``sweeps`` sweeps over the margins; ``step`` gives w from a margin's sums.

    A counted few cells are swept BLOCK times over by windows in one task, without a shuffle; more are
    aggregated by margin and joined, a sweep at a time."""
    names = cells.columns
    few = cells.count() <= FEW_CELLS
    full = F.sum(F.lit(0.0)) if full is None else full
    for n in range(0, sweeps, BLOCK if few else 1):
        before = cells
        cells = cells.coalesce(1).withColumn("_before", F.col("w")) if few else cells
        for _ in range(min(BLOCK, sweeps - n) if few else 1):
            for d in DIMS:
                if few:
                    w = Window.partitionBy(d)
                    cells = cells.select("*", have.over(w).alias("_have"), full.over(w).alias("_full")).select(*[c for c in names if c != "w"], "_before", step(d).alias("w"))
                else:
                    cells = cells.join(cells.groupBy(d).agg(have.alias("_have"), full.alias("_full")), d).select(*[c for c in names if c != "w"], step(d).alias("w"))
        if not few:
            cells = before.select(*DIMS, F.col("w").alias("_before")).join(cells, list(DIMS))
        cells = materialize(cells, "raked")  # a sweep's plan is read by the next three times over
        moved = cells.agg(F.max(F.abs(F.col("w") - F.col("_before")) / F.col("n"))).first()[0]
        cells = cells.select(*names)
        if not moved or moved < 1e-12:
            break
    return cells


def _scale(cells: DataFrame, want: float) -> float:
    """The factor at which n * min(1, factor * weight) sums to ``want``: each round sets aside the cells that
    reach 1, so it ends after as many rounds as there are steps of such cells, a few in practice."""
    scale = 0.0
    while True:
        full = F.col("weight") * F.lit(scale) >= 1
        r = cells.agg(F.sum(F.when(full, F.col("n")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("n") * F.col("weight"))).alias("rest")).first()
        if not r["rest"]:
            return scale or 1.0
        new = (want - r["full"]) / r["rest"]
        if new <= scale * (1 + 1e-12):
            return scale
        scale = new


def mixed(docs: DataFrame, alpha: float = 0.7, sweeps: int = 10, share: float = 0.8) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns."""
    cells = materialize(_cells_of(docs), "tokens")
    keys = fresh(docs.columns, "_source", "_lang", "_topic", "_probability")
    weights = _fit(cells, alpha, sweeps, share, None).select(*DIMS, "probability").toDF(*keys)
    keyed = docs.withColumns(dict(zip(keys, (F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), topic()))))
    out = keyed.join(weights, keys[:3], "left")
    return out.where((tokens() == 0) | (F.expr(_U) < F.coalesce(keys[3], F.lit(0.0)))).select(*docs.columns)


def oracle(alpha: float = 0.7, sweeps: int = 10, share: float = 0.8) -> str:
    """The same in DuckDB's SQL, each sweep written out."""
    text = "coalesce(text, '')"
    count = "length({0}) - length(replace({0}, '{1}', ''))"
    digits = f"(length({text}) - length(translate({text}, '0123456789', '')))"
    parts = [f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
      CASE WHEN length({text}) = 0 THEN 'empty' WHEN {digits} * 50 >= length({text}) THEN 'numeric'
           WHEN (length({text}) - length(translate({text}, chr(10), ''))) * 100 >= length({text}) THEN 'lines' ELSE 'prose' END AS topic,
      CAST(CASE WHEN length({text}) = 0 THEN 0 ELSE length({text}) - length(translate({text}, ' ' || chr(10), '')) + 1 END AS BIGINT) AS tokens FROM documents)""",
      "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL HAVING sum(tokens) > 0)", "t AS (SELECT sum(n) AS total FROM c)"]
    for dim in DIMS:
        parts.append(f"""m_{dim} AS (SELECT {dim}, sum(n) AS own, pow(sum(n), {alpha}) / sum(pow(sum(n), {alpha})) OVER () AS goal FROM c GROUP BY {dim})""")
        parts.append(_level(f"k_{dim}", f"(SELECT own AS n, goal / own AS weight FROM m_{dim}), t", f"{share} * total"))
        parts.append(f"g_{dim} AS MATERIALIZED (SELECT {dim}, goal, own, least(own, goal * scale) AS take, own <= goal * scale AS whole FROM m_{dim}, k_{dim})")
    last = "(SELECT *, n AS w FROM c)"
    for s in range(sweeps):
        for dim in DIMS:
            name = f"r{s}_{dim}"
            parts.append(f"{name} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, n, w * goal * total / sum(w) OVER (PARTITION BY x.{dim}) AS w FROM {last} x JOIN g_{dim} USING ({dim}), t)")
            last = name
    fitted, last = last, f"(SELECT source, lang, topic, n, w * {share} AS w FROM {last})"
    for s in range(sweeps):
        for dim in DIMS:
            name = f"b{s}_{dim}"
            parts.append(f"""{name} AS MATERIALIZED (SELECT source, lang, topic, n, CASE WHEN whole THEN greatest(w, n)
              WHEN filled >= take * {NEARLY!r}::DOUBLE AND filled > 0 THEN w * take / (filled + room) WHEN room > 0 THEN w * greatest(take - filled, 0) / room ELSE w END AS w
              FROM (SELECT *, sum(CASE WHEN w >= n * {NEARLY!r}::DOUBLE THEN n ELSE 0 END) OVER p AS filled, sum(CASE WHEN w >= n * {NEARLY!r}::DOUBLE THEN 0 ELSE w END) OVER p AS room FROM {last} WINDOW p AS (PARTITION BY {dim})) JOIN (SELECT {dim}, take, whole FROM g_{dim}) USING ({dim}))""")
            last = name
    parts.append(_level("s", f"(SELECT n, w / n AS weight FROM {last}), t", f"{share} * total"))
    parts.append(f"f AS (SELECT source, lang, topic, x.w / x.n AS weight, least(y.w / y.n * scale, 1.0) AS probability FROM {fitted} x JOIN {last} y USING (source, lang, topic), s)")
    u = "CAST(('0x' || substr(md5(CAST(coalesce(doc_id, -1) AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"
    return "WITH " + ",\n".join(parts) + f"""
    SELECT doc_id, source, lang, topic, tokens, round(CASE WHEN tokens = 0 THEN 1.0 ELSE weight END, 6) AS weight,
      round(CASE WHEN tokens = 0 THEN 1.0 ELSE probability END, 6) AS probability, {u} < CASE WHEN tokens = 0 THEN 1.0 ELSE probability END AS sampled
    FROM d LEFT JOIN f USING (source, lang, topic)"""


def _level(name: str, cells: str, want: str) -> str:
    """SQL of a table with the factor at which n * min(1, factor * weight) sums to ``want``."""
    return f"""{name}_o AS MATERIALIZED (SELECT weight, ({want} - coalesce(sum(n) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(n * weight) OVER (ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM {cells}),
    {name} AS MATERIALIZED (SELECT arg_max(scale, weight) AS scale FROM {name}_o WHERE scale * weight < 1)"""
