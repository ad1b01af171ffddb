"""Benchmark decontamination by template windows.

Numbers, names and units of a text become typed placeholders, so a question that was copied with other
values keeps its template. Windows of plain words and of template tokens of benchmark items and documents
meet in a hash join (a Bloom filter first drops windows that no item has); matches on one diagonal form a
run, and a run counts if its slots agree: each value of the item stands for one value of the document, and
no two for the same. A stretch of plain words counts by itself, whatever the slots around it do. Items of
fewer words than a window are one window of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, fresh, materialize, mix64, small_batches, text_slices, windows_of, words_of
from .urlfilter import build_filter, probe

#: Units of measure that follow a number.
UNITS = "mm cm m km in ft yd mi miles mile meters metres g kg mg lb lbs oz grams s sec seconds min minutes h hr hours day days week weeks month months year years l ml litre litres liter liters gallon gallons percent dollars dollar cents euro euros usd eur degrees mph kmh watts volts joules".split()
WIDTH = 8
LITERALS = 3
BROADCAST_ROWS = 1_000_000
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_END = np.zeros(256, bool)
_END[list(b".!?:;\n\r\"")] = True


def _unit_hashes() -> np.ndarray:
    data = " ".join(UNITS).encode()
    return np.sort(words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[3])


def templates(data: np.ndarray, offsets: np.ndarray, units: np.ndarray):
    """Per word: (text index, plain hash, [(template token, is slot) twice]). Number: digits only; unit: a listed
    word after a number; name: a word with a capital and then a small letter that doesn't open a sentence, and
    in the second template also one that does if the text has it as a name elsewhere."""
    starts, ends, doc, plain = words_of(data, offsets)
    if not len(starts):
        return doc, plain, [(plain, np.zeros(0, bool))] * 2
    digit = (data >= 48) & (data <= 57)
    seen = np.concatenate([[0], np.cumsum(digit, dtype=np.int64)])
    number = seen[ends] - seen[starts] == ends - starts
    stops = np.concatenate([[0], np.cumsum(_END[data], dtype=np.int64)])
    same = np.concatenate([[False], doc[1:] == doc[:-1]])
    before = np.concatenate([[0], ends[:-1]])
    opens = ~same | (stops[starts] > stops[before])
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = (data[starts] >= 65) & (data[starts] <= 90) & (ends - starts > 1) & ((second >= 97) & (second <= 122) | (second >= 128))
    name = capital & ~opens
    named = name.copy()
    mine = plain ^ mix64(doc.astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(capital & opens)
    named[at] = np.isin(mine[at], mine[name])
    after = same & np.concatenate([[False], number[:-1]])
    at = np.minimum(np.searchsorted(units, plain), len(units) - 1)
    unit = after & (units[at] == plain)
    return doc, plain, [(np.where(number, _NUM, np.where(unit, _UNIT, np.where(x, _NAME, plain))), number | unit | x) for x in (name, named)]


def _windows(table: DataFrame, key: str, blocks=None, widths: list[int] | None = None, row=None) -> DataFrame:
    """(key, _row, n, at, h, kind, fit, slots): windows of plain words (kind 0) and, where they have slots and at
    least LITERALS words that aren't, of either template (1, 2); given a filter, those that may be an item's.
    ``widths`` are the sizes of windows; without them a text is cut into WIDTH words, or is one window if it
    has fewer. ``row`` names rows, else they are numbered. ``fit`` is the number of the text's windows with LITERALS."""
    kind = dict(table.dtypes)[key]
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())

    def run(batches):
        drop_caches()
        units = _unit_hashes()
        bloom = blocks.value if blocks is not None else None
        for batch in batches:
            keys, rows = batch.column(key), batch.column("_row").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column("text"), 1 << 20):
                doc, plain, both = templates(data, offsets, units)
                first = np.searchsorted(doc, np.arange(hi - lo))
                size = np.searchsorted(doc, np.arange(hi - lo), "right") - first
                for width in widths or range(1, WIDTH + 1):
                    fit, last = np.zeros(hi - lo, np.int64), None
                    parts = []
                    for kind_no, (token, slot) in ((1, both[0]), (2, both[1]), (0, (plain, both[0][1]))):
                        at, h = windows_of(token, doc, width)
                        if widths is None and width < WIDTH:
                            ok = size[doc[at]] == width
                        else:
                            ok = np.ones(len(at), bool)
                        n_slots = np.concatenate([[0], np.cumsum(slot, dtype=np.int64)])
                        slots_in = n_slots[at + width] - n_slots[at]
                        if kind_no == 1:
                            fit = np.bincount(doc[at[ok & (slots_in <= width - LITERALS)]], minlength=hi - lo)
                            last = h
                        if kind_no:
                            ok &= (slots_in > 0) & (slots_in <= width - LITERALS)
                        if kind_no == 2:
                            ok &= h != last
                        if bloom is not None and len(h):
                            ok[ok] = probe(bloom, h[ok].view(np.int64))
                        parts.append((kind_no, slot, at[ok], h[ok]))
                    for kind_no, slot, at, h in parts:
                        d = doc[at]
                        for a in range(0, len(at), 20_000):
                            part, dd = at[a : a + 20_000], d[a : a + 20_000]
                            grid = part[:, None] + np.arange(width)
                            flags = slot[grid]
                            counts = np.concatenate([[0], np.cumsum(flags.sum(1))])
                            slots = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(plain[grid][flags].view(np.int64)))
                            columns = [pa.array(size[dd], pa.int64()), pa.array(part - first[dd], pa.int64()), pa.array(h[a : a + 20_000].view(np.int64)), pa.array(np.full(len(part), kind_no), pa.int64()), pa.array(fit[dd], pa.int64()), slots]
                            yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo).take(pa.array(dd)).cast(arrow_kind), pa.array(rows[lo + dd]), *columns], names=[key, "_row", "n", "at", "h", "kind", "fit", "slots"])

    source = table.select(table[key].alias(key), (F.monotonically_increasing_id() if row is None else row).alias("_row"), table["text"].alias("text"))
    return source.mapInArrow(run, f"{key} {kind}, _row long, n long, at long, h long, kind long, fit long, slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_share: float = 0.8) -> DataFrame:
    """Rows (doc_id, item_id, words, share, exact, places): documents that hold a benchmark item's passage.

    A run counts from ``min_words`` words or from ``min_share`` of an item's windows (of those with LITERALS,
    where values differ). ``exact``: all slot values are the item's; else the passage is re-parameterised
    consistently. Of a run whose slots conflict the longest stretch that is the item's word for word counts, by
    the same limits. ``places``: runs in the document. Documents and items are read whole; items under 8 words
    are searched as one window; null and empty texts match nothing; items with the same text each give a row; repeated rows of a document count as places of its
    id; null ids stay null; empty tables give no rows; other columns are ignored.
    """
    runs = _runs(docs, benchmark, min_words, min_share)
    return runs.groupBy("doc_id", "item_id").agg(F.max("words").cast("long").alias("words"), F.max("share").alias("share"), F.max("exact").alias("exact"), F.count("*").alias("places"))


def _runs(docs: DataFrame, benchmark: DataFrame, min_words: int, min_share: float, row=None) -> DataFrame:
    """The runs that count, each with its _row, doc_id, item_id, words, share and exact."""
    small_batches(docs.sparkSession)
    items = materialize(_windows(benchmark, "item_id").select(F.col("item_id"), F.col("_row").alias("_item"), F.col("n").alias("_n"), F.col("at").alias("_at"), "h", F.col("kind").alias("_kind"), F.col("fit").alias("_fit"), F.col("slots").alias("_want")), "items")
    blocks = docs.sparkSession.sparkContext.broadcast(build_filter(items.select(F.col("h").alias("key")).distinct(), hashed=True))
    widths = sorted(r[0] for r in items.select(F.least("_n", F.lit(WIDTH)).cast("int")).distinct().collect())  # at most WIDTH
    hits = _windows(docs, "doc_id", blocks, widths or [WIDTH], row)
    if items.count() <= BROADCAST_ROWS:
        pairs = hits.join(F.broadcast(items), "h")
    else:  # a window that many documents share is dealt to 16 tasks
        salted = items.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        pairs = hits.withColumn("_salt", F.pmod("_row", F.lit(16)).cast("int")).join(salted, ["h", "_salt"])
    # a window of plain words is the item's own, slots and all
    pairs = pairs.withColumn("slots", F.when(F.col("_kind") == 0, F.col("_want")).otherwise(F.col("slots")))
    # a run is read in three ways: with all windows, with those of the templates, with those of the first one;
    # what another way adds must not break a run that agrees without it
    plain = F.size("_want") == 0
    ways = [F.lit(True), (F.col("_kind") > 0) | plain, (F.col("_kind") == 1) | plain]
    pair = F.arrays_zip("_want", "slots")
    aggs = [x for i, way in enumerate(ways) for x in (F.size(F.collect_set(F.when(way, F.col("_at")))).alias(f"_n{i}"), F.array_distinct(F.flatten(F.collect_set(F.when(way, pair)))).alias(f"_map{i}"))]
    runs = pairs.groupBy("_row", "doc_id", "_item", "item_id", (F.col("at") - F.col("_at")).alias("_diagonal")).agg(F.first("_n").alias("_n"), F.first("_fit").alias("_fit"), F.collect_set(F.when(F.col("_kind") == 0, F.col("_at"))).alias("_plain"), *aggs)
    # consistent: a one-to-one map from the item's slot values to the document's
    agrees = "size({0}) = size(array_distinct({0}._want)) AND size({0}) = size(array_distinct({0}.slots))"
    size = F.least("_n", F.lit(WIDTH))
    # where no reading agrees: the longest stretch of windows that are the item's word for word
    stretch = "aggregate(array_sort(_plain), named_struct('best', 0, 'run', 0, 'last', cast(-2 as bigint)), (s, x) -> named_struct('best', greatest(s.best, CASE WHEN x = s.last + 1 THEN s.run + 1 ELSE 1 END), 'run', CASE WHEN x = s.last + 1 THEN s.run + 1 ELSE 1 END, 'last', x), s -> s.best)"
    read = [F.when(F.expr(agrees.format(f"_map{i}")), F.struct(F.col(f"_n{i}").alias("windows"), F.col(f"_map{i}").alias("map"))) for i in range(len(ways))]
    run = F.coalesce(*read, F.struct(F.expr(stretch).alias("windows"), F.expr("filter(_map0, x -> false)").alias("map")))
    runs = runs.withColumn("_run", run).where("_run.windows > 0")
    runs = runs.withColumn("words", F.col("_run.windows") + size - 1).withColumn("exact", F.expr("forall(_run.map, x -> x._want = x.slots)"))
    share = F.col("_run.windows") / (F.col("_n") - size + 1)
    runs = runs.withColumn("share", F.when(F.col("exact"), share).otherwise(F.greatest(share, F.least(F.least("_run.windows", "_n1") / F.greatest("_fit", F.lit(1)), F.lit(1.0)))))
    return runs.where((F.col("words") >= min_words) | (F.col("share") >= min_share))


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their own columns.

    Rows go one by one, known by id and text, so null and repeated ids keep the rows that are clean."""
    key, gone_id, gone_key = fresh(docs.columns, "_key", "_gone_id", "_gone_key")
    named = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    found = materialize(_runs(docs, benchmark, min_words, min_share, named).select(F.col("doc_id").alias(gone_id), F.col("_row").alias(gone_key)).distinct(), "contaminated")
    if found.count() <= BROADCAST_ROWS:  # else texts are shuffled
        found = F.broadcast(found)
    keyed = docs.withColumn(key, named)
    return keyed.join(found, docs["doc_id"].eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti").select(*docs.columns)
