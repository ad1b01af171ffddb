"""URL filter: a blocked Bloom filter, then an exact hash join.

Listed keys (rules' host and path, and canonical URLs) fill a Bloom filter whose every key touches one
512-bit block. Urls whose candidate keys may be listed go on to an exact join, which removes false hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Odd multipliers, one a 64-bit lane of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x2AE1EA5B, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31, 0x3A4D5A6F)
MAX_BLOCKS = 1 << 19
BROADCAST_ROWS = 200_000
_LOW = (1 << 32) - 1


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host, path and canonical to a table with _url."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = pages.withColumn("_rest", F.expr("CASE WHEN instr(_url, '://') > 0 THEN substring(_url, instr(_url, '://') + 3) ELSE '' END"))
    out = out.withColumn("host", F.expr(lower.format("regexp_extract(_rest, '^[^/?#]*', 0)")))
    out = out.withColumn("path", F.expr("regexp_extract(substring(_rest, length(host) + 1), '^[^?#]*', 0)"))
    out = out.withColumn("_query", F.expr(r"regexp_extract(substring(_rest, length(host) + length(path) + 1), '^[?]([^#]*)', 1)"))
    out = out.withColumn("_query", F.expr(r"ltrim('&', regexp_replace(concat('&', _query), '&(utm_[^&=]*|ref|fbclid|gclid)=[^&]*', ''))"))
    out = out.withColumn("canonical", F.expr(r"concat(regexp_replace(host, '^(www|m)[.]', ''), regexp_replace(path, '/+$', ''), CASE WHEN _query = '' THEN '' ELSE concat('?', _query) END)"))
    return out.drop("_rest", "_query")


def _lane_bits(h: str):
    return [f"shiftleft(1L, cast(shiftright(({h} & {_LOW}L) * {s}L, 26) & 63 as int))" for s in SALTS]


def build_filter(keys: DataFrame, key: str = "key", bits_per_key: int = 16, hashed: bool = False) -> np.ndarray:
    """Blocks of a blocked Bloom filter, an array (blocks, 8). Bits are set on executors; the driver gets
    at most MAX_BLOCKS rows (32 MB); a longer list only raises the share of false hits. ``hashed``: the
    keys are 64-bit hashes already."""
    n = keys.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n * bits_per_key // 512)))
    rows = keys.select(F.col(key) if hashed else F.xxhash64(key)).toDF("h").select(F.expr(f"shiftright(shiftrightunsigned(h, 33) * {blocks}L, 31)").alias("block"), *[F.expr(x).alias(f"w{i}") for i, x in enumerate(_lane_bits("h"))])
    rows = rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]).toArrow()
    out = np.zeros((blocks, 8), np.int64)
    out[rows["block"].to_numpy()] = np.stack([rows[f"w{i}"].to_numpy() for i in range(8)], 1)
    return out.view(np.uint64)


def probe(blocks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes may be listed."""
    h = h.view(np.uint64)
    lanes = blocks[((h >> np.uint64(33)) * np.uint64(len(blocks))) >> np.uint64(31)]
    low, ok = h & np.uint64(_LOW), np.ones(len(h), bool)
    for i, s in enumerate(SALTS):
        ok &= (lanes[:, i] >> (((low * np.uint64(s)) >> np.uint64(26)) & np.uint64(63))) & np.uint64(1) == 1
    return ok


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame | None, default: str = "allow") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict), one for each row of ``pages`` (page_id, url).

    ``rules`` are (verdict, host, path): a rule fits its host and subdomains where the path starts with
    its own; the longest fitting one wins (then the longer host). Else a url whose canonical form is in
    ``listed`` (column canonical) is blocked, else ``default`` holds. A null url or one without ``://``
    has empty host and path and fits nothing. Repeated rows stay; an empty table gives no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    rows = with_parts(materialize(pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("_url"), F.monotonically_increasing_id().alias("_row")), "urls"))
    keys = spark.createDataFrame([(h + p, h + p, v, len(h) + len(p), len(h)) for v, h, p in rules], "key string, rule string, verdict string, size int, hosts int")
    if listed is not None:
        exact = listed.where("canonical != ''").select(F.concat(F.lit("="), "canonical").alias("key")).distinct()
        keys = keys.unionByName(exact.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(-1).alias("size"), F.lit(-1).alias("hosts")))
    keys = materialize(keys, "url-list")
    blocks = spark.sparkContext.broadcast(build_filter(keys))
    sizes = sorted({len(p) for _, _, p in rules})
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))"
    prefixes = ", ".join(f"CASE WHEN length(path) >= {n} THEN substring(path, 1, {n}) END" for n in sizes) or "cast(null as string)"
    rows = rows.withColumn("_keys", F.expr(f"CASE WHEN host = '' THEN array() ELSE array_append(array_distinct(flatten(transform(array_compact(array({prefixes})), p -> transform({suffixes}, s -> concat(s, p))))), concat('=', canonical)) END").cast("array<string>"))
    rows = rows.withColumn("_hash", F.expr("transform(_keys, k -> xxhash64(k))")).select("_row", "page_id", "host", "path", "_keys", "_hash")

    def check(batches):
        table = blocks.value
        for batch in batches:
            lists, hashes = batch.column("_keys"), batch.column("_hash")
            ok = probe(table, np.ascontiguousarray(hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False)))])
            counts = np.concatenate([[0], np.cumsum(ok)])[ends]
            kept = lists.flatten().filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_row", "page_id", "host", "path")], pa.ListArray.from_arrays(pa.array(counts, pa.int32()), kept)], names=["_row", "page_id", "host", "path", "_keys"])

    page_type = dict(pages.dtypes)["page_id"]
    rows = rows.mapInArrow(check, f"_row long, page_id {page_type}, host string, path string, _keys array<string>")
    hits = rows.select("_row", "page_id", "host", "path", F.explode_outer("_keys").alias("key"))
    if keys.count() <= BROADCAST_ROWS:  # the list's size is known: small enough for every executor
        joined = hits.join(F.broadcast(keys), "key", "left")
    else:  # a key like a bare top-level domain may hold a third of the urls: deal each key to 16 tasks
        salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = hits.withColumn("_salt", F.pmod("_row", F.lit(16)).cast("int")).join(salted, ["key", "_salt"], "left")
    best = F.max_by(F.struct("rule", "verdict"), F.when(F.col("verdict").isNotNull(), F.struct("size", "hosts"))).alias("best")
    out = joined.groupBy("_row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
