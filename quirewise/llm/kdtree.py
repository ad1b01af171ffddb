"""K-d tree sharding by distributed weighted medians.

The rows' narrow metadata is split again and again: each node takes its widest metadata dimension
(spread relative to the whole table's) and cuts at the weighted median, found by refining histograms
that executors aggregate; the driver sees at most ``BINS`` sums a node. Equal texts stand next to each
other in the order that is cut, so a cut falls between groups of copies when one such place is within
tolerance, and only a group too large for that is divided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BINS = 1024
_SPLIT = "_node long, _dim int, _c int, _t0 double, _t1 long, _t2 long, _t3 long, _left long, _right long"


def _coordinate(c: int):
    """Component c of the order that a node cuts: its dimension, then text group, id and row."""
    if c == 0:
        return F.when(F.col("_dim") >= 0, F.element_at("_dims", F.col("_dim") + 1)).otherwise(F.lit(0.0))
    return F.col(("_text_key", "_id", "_row")[c - 1])


def _metadata(docs: DataFrame, dims: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)
    values = []
    for d in dims:
        number = kinds[d] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[d].startswith("decimal")
        x = F.log1p(F.greatest(F.col(d).cast("double"), F.lit(0.0))) if number else F.crc32(F.col(d).cast("string")).cast("double")
        values.append(F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(-1.0)))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("_text_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        F.array(*values).cast("array<double>").alias("_dims"),
        F.lit(0).cast("long").alias("_node"),
    )


def kdtree_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("n_chars", "source", "lang"), tolerance: float = 0.002) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) with shards of near-equal bytes.

    Give ``shards``, or ``target_bytes`` for as many leaves as keep each near that size. ``size`` is the
    text's UTF-8 bytes plus 8 (null text: 8). Dimensions: numbers on a log scale, anything else by CRC-32
    (null: below all); absent ones are left out. Null ids sort first. Repeated rows are kept, each with its
    own slot; they may be divided like any group. An empty table gives no rows. Other columns are ignored.
    """
    if not (shards or target_bytes):
        raise ValueError("give shards or target_bytes")
    spark = docs.sparkSession
    dims = [d for d in dims if d in docs.columns]
    rows = materialize(_metadata(docs, dims), "kdtree")
    spread = [f(F.element_at("_dims", i + 1)).alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("_id").alias("id0"), F.max("_id").alias("id1"), F.max("_row").alias("row1"), *spread).first()
    total = whole["b"] or 0
    shards = shards or max(1, round(total / target_bytes))
    leaf_bytes = total / shards
    widths = [((whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0)) for i in range(len(dims))]

    leaves: dict[int, tuple[int, int]] = {0: (0, shards)}  # node: first leaf, number of leaves
    next_node, level = 1, 0
    while any(k > 1 for _, k in leaves.values()) and whole["n"]:
        active = {n: v for n, v in leaves.items() if v[1] > 1}
        live = rows.where(F.col("_node").isin(*active)) if len(active) < 200 else rows
        found = {r["_node"]: r for r in live.groupBy("_node").agg(F.sum("size").alias("b"), *spread).collect()}
        search = {}
        for node, (first, k) in active.items():
            if node not in found:
                continue  # no rows: its leaves stay empty
            r = found[node]
            share = [(r[f"hi{i}"] - r[f"lo{i}"]) / widths[i] if widths[i] > 0 else 0.0 for i in range(len(dims))]
            dim = max(range(len(dims)), key=lambda i: share[i], default=-1)
            if dim < 0 or share[dim] <= 0:
                dim, lo, hi = -1, 0.0, 0.0
            else:
                lo, hi = r[f"lo{dim}"], r[f"hi{dim}"]
            search[node] = {"dim": dim, "c": 0, "lo": lo, "hi": hi, "fixed": [], "below": 0, "want": r["b"] * (k // 2) / k}
        cuts: dict[int, tuple] = {}
        while search:
            bins = max(16, min(BINS, (1 << 18) // len(search)))
            _refine(spark, rows, search, cuts, bins, tolerance * leaf_bytes)
        splits = []
        for node, (first, k) in active.items():
            leaves.pop(node)
            left, right, next_node = next_node, next_node + 1, next_node + 2
            leaves[left], leaves[right] = (first, k // 2), (first + k // 2, k - k // 2)
            if node in cuts:
                splits.append((node, *cuts[node], left, right))
        table = spark.createDataFrame(splits, _SPLIT)  # a row a node: fewer than the shards
        right = F.lit(False)
        for c in (3, 2, 1, 0):  # lexicographic (coordinates >= cut), of which the first _c + 1 count
            v, t = _coordinate(c), F.col(f"_t{c}")
            right = F.when(F.col("_c") == c, v >= t).otherwise((v > t) | ((v == t) & right))
        rows = rows.join(F.broadcast(table), "_node", "left").withColumn("_node", F.when(F.col("_left").isNull(), F.col("_node")).when(right, F.col("_right")).otherwise(F.col("_left"))).drop("_dim", "_c", "_t0", "_t1", "_t2", "_t3", "_left", "_right")
        level += 1
        if level % 4 == 0:
            rows = materialize(rows, "kdtree")
    shard_of = spark.createDataFrame([(n, first) for n, (first, _) in leaves.items()], "_node long, shard int")
    rows = rows.join(F.broadcast(shard_of), "_node").select("doc_id", "size", "text_crc32", "shard", F.col("_row"))
    return _slots(materialize(rows, "kdtree"), whole["n"], shards)


def _refine(spark, rows: DataFrame, search: dict, cuts: dict, bins: int, slack: float) -> None:
    """One histogram pass over the rows that still matter; nodes whose cut is found move to ``cuts``."""
    state = spark.createDataFrame([(n, s["dim"], s["c"], *([*s["fixed"], None, None, None, None][:4]), *((float(s["lo"]), float(s["hi"]), None, None) if s["c"] == 0 else (None, None, int(s["lo"]), int(s["hi"])))) for n, s in search.items()], "_node long, _dim int, _c int, _f0 double, _f1 long, _f2 long, _f3 long, _lo double, _hi double, _llo long, _lhi long")
    keep, value, bucket = F.lit(False), F.lit(None).cast("long"), F.lit(None).cast("long")
    for c in range(4):
        v, here = _coordinate(c), F.col("_c") == c
        equal = F.lit(True)
        for p in range(c):
            equal = equal & (_coordinate(p) == F.col(f"_f{p}"))
        if c == 0:
            inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
            place = F.least(F.floor((v - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)) * bins), F.lit(bins - 1)).cast("long")
        else:
            inside = (v >= F.col("_llo")) & (v <= F.col("_lhi"))
            place = F.expr(f"({('', '_text_key', '_id', '_row')[c]} - _llo) div ((_lhi - _llo) div {bins} + 1)")
        keep = F.when(here, equal & inside).otherwise(keep)
        bucket = F.when(here, place).otherwise(bucket)
    ends = [f(_coordinate(c)).alias(f"{n}{c}") for c in range(4) for n, f in (("lo", F.min), ("hi", F.max))]
    sums = rows.join(F.broadcast(state), "_node").where(keep).groupBy("_node", bucket.alias("bin")).agg(F.sum("size").alias("b"), *ends).collect()
    by: dict[int, list] = {}
    for r in sums:
        by.setdefault(r["_node"], []).append(r)
    for node, s in list(search.items()):
        here, c = sorted(by[node], key=lambda r: r["bin"]), s["c"]
        acc = s["below"]
        for i, r in enumerate(here):
            if acc + r["b"] >= s["want"] or i + 1 == len(here):
                break
            acc += r["b"]
        under, over = s["want"] - acc, acc + r["b"] - s["want"]
        single = r[f"lo{c}"] == r[f"hi{c}"]
        stuck = not single and (r[f"lo{c}"], r[f"hi{c}"]) == (s["lo"], s["hi"]) and c == 0 and len(here) == 1
        cut = None
        if under <= slack or (single and c == 3 and under <= over):
            cut = r[f"lo{c}"]
        elif abs(over) <= slack or (single and c == 3):
            cut = here[i + 1][f"lo{c}"] if i + 1 < len(here) else (r[f"hi{c}"] + 1 if c else float(r["hi0"]) * (1 + 1e-12) + 1e-9)
        if cut is not None:
            t = [*s["fixed"], cut, None, None, None][:4]
            cuts[node] = (s["dim"], c, float(t[0]), *t[1:])
            del search[node]
        elif single or stuck:
            s.update(c=c + 1, fixed=[*s["fixed"], r[f"lo{c}"]], lo=r[f"lo{c + 1}"], hi=r[f"hi{c + 1}"], below=acc)
        else:
            s.update(lo=r[f"lo{c}"], hi=r[f"hi{c}"], below=acc)


def _slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """Gapless numbers in each shard: numbered in hashed buckets of bounded size, then moved by the buckets' counts."""
    from pyspark.sql import Window

    buckets = max(1, n // max(1, shards) // 50_000)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_row")
    numbered = rows.withColumn("_at", F.row_number().over(inside))
    return numbered.join(counts, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
