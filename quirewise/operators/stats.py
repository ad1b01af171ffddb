"""Document statistics: one pass of aggregates each over spans, lines and pages.

Relations: pages (doc_id, page, width, height), lines (doc_id, page, line_no, text, bbox, dir_x, dir_y),
spans (doc_id, page, line_no, span_no, text, x0, x1, size, bold). Every grouping key starts with doc_id, so
one hash partitioning by doc_id serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import furniture_key, is_blank, meaningful

# Thresholds of the measurements.
MARGIN_BAND, REPEAT_SHARE = 0.15, 0.6
GUTTER_BAND, GUTTER_TOGETHER, COLUMN_LINES, PAGE_LINES = 0.5, 0.5, 4, 8
GUTTER_CELLS = 1 << 20
LINE = ["doc_id", "page", "line_no"]


def horizontal(dir_x: str = "dir_x", dir_y: str = "dir_y") -> Column:
    return F.abs(F.col(dir_x)) > F.abs(F.col(dir_y))


def measurable(lines: DataFrame) -> DataFrame:
    """Horizontal lines with at least two letters or digits."""
    return lines.where(horizontal() & (meaningful(F.col("text")) >= 2))


def body_size(spans: DataFrame) -> DataFrame:
    """(doc_id, body_font_size): the rounded size with most characters; of equals, the first to appear."""
    sized = spans.where("size > 0").select("doc_id", F.bround("size", 1).alias("size"), F.length("text").alias("n"), F.struct("page", "line_no", "span_no").alias("at"))
    by = sized.groupBy("doc_id", "size").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    top = Window.partitionBy("doc_id").orderBy(F.desc("n"), "at")
    return by.withColumn("r", F.row_number().over(top)).where("r = 1").select("doc_id", F.col("size").alias("body_font_size"))


def font_histogram(spans: DataFrame) -> DataFrame:
    return spans.where("size > 0").groupBy("doc_id", F.bround("size", 1).alias("size")).agg(F.count("*").alias("n"))


def span_stats(spans: DataFrame) -> DataFrame:
    """(doc_id, bold_ratio, median_character_width)."""
    n = F.length("text")
    width = F.when(n > 0, (F.col("x1") - F.col("x0")) / n).otherwise(0.0)
    return spans.groupBy("doc_id").agg(
        F.when(F.sum(n) > 0, F.sum(F.when(F.col("bold"), n).otherwise(0)) / F.sum(n)).otherwise(0.0).alias("bold_ratio"),
        F.coalesce(F.median(F.when(width > 0, width)), F.lit(0.0)).alias("median_character_width"),
    )


def page_stats(lines: DataFrame) -> DataFrame:
    """Per page: margins, median line height and median gap to the next line (where it isn't above)."""
    order = Window.partitionBy("doc_id", "page").orderBy("line_no")
    nxt = F.lead("bbox").over(order)
    gap = F.when(nxt["y0"] >= F.col("bbox.y0"), nxt["y0"] - F.col("bbox.y1"))
    return lines.withColumn("gap", gap).groupBy("doc_id", "page").agg(
        F.min("bbox.x0").alias("left_margin"),
        F.max("bbox.x1").alias("right_margin"),
        F.coalesce(F.median(F.when(F.col("bbox.y1") > F.col("bbox.y0"), F.col("bbox.y1") - F.col("bbox.y0"))), F.lit(0.0)).alias("median_line_height"),
        F.coalesce(F.median(F.when(F.col("gap") >= 0, F.col("gap"))), F.lit(0.0)).alias("median_line_gap"),
    )


def doc_stats(pages: DataFrame) -> DataFrame:
    """Medians of page medians; margins over pages."""
    return pages.groupBy("doc_id").agg(
        F.coalesce(F.median("median_line_height"), F.lit(0.0)).alias("median_line_height"),
        F.coalesce(F.median(F.when(F.col("median_line_gap") > 0, F.col("median_line_gap"))), F.lit(0.0)).alias("median_line_gap"),
        F.coalesce(F.min(F.when(F.col("left_margin") > 0, F.col("left_margin"))), F.lit(0.0)).alias("left_margin"),
        F.max("right_margin").alias("right_margin"),
    )


def repeated_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, key, band): running headers and footers, on at least 60 % (and two) of a document's pages."""
    many = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).where("pages >= 2")
    placed = lines.join(pages.select("doc_id", "page", "height").where("height > 0"), ["doc_id", "page"]).where(~is_blank(F.col("text")))
    band = F.when(F.col("bbox.y0") <= F.col("height") * MARGIN_BAND, "header").when(F.col("bbox.y1") >= F.col("height") * (1 - MARGIN_BAND), "footer")
    keyed = placed.select("doc_id", "page", furniture_key(F.col("text")).alias("key"), band.alias("band")).where("band is not null")
    seen = keyed.distinct().groupBy("doc_id", "key", "band").agg(F.count("*").alias("seen"))
    return seen.join(many, "doc_id").where(F.col("seen") >= F.greatest(F.lit(2), F.floor(F.col("pages") * REPEAT_SHARE))).select("doc_id", "key", "band")


def furniture(lines: DataFrame, pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """``lines`` with a column furniture: text and place of a running header or footer."""
    keyed = lines.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"], "left").withColumn("key", furniture_key(F.col("text")))
    keys = repeated.groupBy("doc_id", "key").agg(F.max(F.when(F.col("band") == "header", 1).otherwise(0)).alias("in_head"), F.max(F.when(F.col("band") == "footer", 1).otherwise(0)).alias("in_foot"))
    out = keyed.join(keys, ["doc_id", "key"], "left")
    hit = (F.col("height") > 0) & (((F.col("in_head") == 1) & (F.col("bbox.y0") <= F.col("height") * MARGIN_BAND)) | ((F.col("in_foot") == 1) & (F.col("bbox.y1") >= F.col("height") * (1 - MARGIN_BAND))))
    return out.withColumn("furniture", F.coalesce(hit, F.lit(False))).drop("key", "height", "in_head", "in_foot")


def extracted_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines without blank ones and furniture, text stripped, numbered anew from 0 in (page, line_no) order."""
    kept = furniture(lines, pages, repeated_lines(lines, pages)).where(~F.col("furniture") & ~is_blank(F.col("text"))).drop("furniture")
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    return kept.withColumn("text", P.strip(F.col("text"))).withColumn("line_index", F.row_number().over(order) - 1)


def indentation_levels(lines: DataFrame, widths: DataFrame) -> DataFrame:
    """(doc_id, levels): left edges in order, a new level where one lies further from the last level's first
    edge than the tolerance. The chain makes this a fold, not a lag."""
    lefts = lines.groupBy("doc_id").agg(F.array_sort(F.collect_set("bbox.x0")).alias("lefts")).join(widths, "doc_id")
    tol = F.greatest(F.lit(2.0), F.col("median_character_width"))
    levels = F.aggregate("lefts", F.expr("cast(array() as array<double>)"), lambda out, x: F.when((F.size(out) == 0) | (x - F.element_at(out, -1) > tol), F.array_append(out, x)).otherwise(out))
    return lefts.select("doc_id", F.transform(levels, lambda x: F.bround(x, 2)).alias("levels"))


def indentation_level(left: Column, levels: Column, char_width: Column) -> Column:
    """The first level within tolerance of a left edge, else their number."""
    tol = F.greatest(F.lit(2.0), char_width)
    at = F.array_position(F.transform(levels, lambda x: F.abs(left - x) <= tol), True)
    return F.when(at > 0, at - 1).otherwise(F.size(levels)).cast("int")


def thresholds(space: Column, char: Column, height: Column, gap: Column, body: Column) -> dict[str, Column]:
    """Gaps that divide words, cells, rows and paragraphs."""
    wide = F.greatest(space, char)
    return {
        "word_gap": F.when(space > 0, space * 0.6).otherwise(char * 0.3),
        "cell_gap": F.when(wide > 0, wide * 5.0).otherwise(0.0),
        "baseline_tolerance": F.when(height > 0, height * 0.5).otherwise(body * 0.5),
        "paragraph_gap": F.greatest(gap * 2.0, height * 0.5),
    }


def free_bands(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, top, bottom): what of [lo, hi] no interval (start, end) covers. Running maximum of the ends, then
    the gap before each interval; intervals are clipped to the range."""
    clipped = intervals.withColumn("s", F.greatest("start", "lo")).withColumn("e", F.least("end", "hi")).where("e > s")
    order = Window.partitionBy(*keys).orderBy("s", "e")
    reached = clipped.withColumn("before", F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("lo")))
    inner = reached.where("s > before").select(*keys, F.col("before").alias("top"), F.col("s").alias("bottom"))
    last = clipped.groupBy(*keys).agg(F.max("e").alias("top"), F.max("hi").alias("bottom")).where("bottom > top")
    return inner.unionByName(last)


def gutters(lines: DataFrame, char_widths: DataFrame) -> DataFrame:
    """(doc_id, page, left, right, top, bottom, left_lines, right_lines): corridors between columns.

    ``lines`` are those that bound columns. At each whole x of a page, the lines that cross it leave free
    bands; a band counts if it is half the page's text high, with four lines on either side that stand beside
    each other for half that height. Neighbouring x make a gutter; it must be wide enough. Which lines cross
    changes only where one ends, so a stretch between two such places is looked at once.
    """
    box = F.struct(*[F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return page_gutters(lines.groupBy("doc_id", "page").agg(F.collect_list(box).alias("boxes")), char_widths)


def page_gutters(pages: DataFrame, char_widths: DataFrame) -> DataFrame:
    """``gutters`` of pages (doc_id, page, boxes). What a page compares is the square of its lines; it stays in the
    memory of one task, in pieces of ``GUTTER_CELLS``, and only gutters leave it."""
    P2 = ["doc_id", "page"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*P2).schema)
    some = pages.where(F.size("boxes") >= PAGE_LINES).select(*P2, "boxes")
    made = some.mapInArrow(_gutters_of_batches, f"{kinds}, left double, right double, top double, bottom double, left_lines long, right_lines long")
    wide = F.col("right") - F.col("left") >= F.greatest(F.lit(2.0), F.col("median_character_width") * 2)
    return made.join(char_widths, "doc_id").where(wide).select(*P2, "left", "right", "top", "bottom", "left_lines", "right_lines")


def piece(n, rows, at: int) -> int:
    """How many of ``rows``, in order of their columns' number n, make at most ``GUTTER_CELLS`` cells from ``at`` on."""
    # the longest is the last
    size = max(1, GUTTER_CELLS // max(1, int(n[rows[at]])))
    while size > 1 and size * int(n[rows[min(at + size, len(rows)) - 1]]) > GUTTER_CELLS:
        size //= 2
    return size


def _gutters_of_batches(batches):
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        boxes = b.column("boxes")
        ends = boxes.offsets.to_numpy()
        flat = boxes.values
        at, found = _gutters_of(ends, *[flat.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")])
        keys = [b.column(k).take(pa.array(at)) for k in ("doc_id", "page")]
        names = ("left", "right", "top", "bottom", "left_lines", "right_lines")
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(v) for v in found]], names=["doc_id", "page", *names])


def _gutters_of(ends, x0, y0, x1, y1):
    """Gutters of pages whose lines stand at ends[i] to ends[i + 1]: the page of each and its six values.

    Each (page, x) is a row, a page's lines from top to bottom are its columns; a row's bands are the gaps
    before a crossing line, below the last one, or all of the page."""
    import numpy as np

    n = np.diff(ends)
    page = np.repeat(np.arange(len(n)), n)
    first_of = np.concatenate([[0], np.cumsum(n)])
    x0, y0, x1, y1 = (v[ends[0] : ends[-1]].astype("float64") for v in (x0, y0, x1, y1))
    edge = lambda f, v, none: f.reduceat(np.where(np.isnan(v), none, v), first_of[:-1])
    l, r, lo, hi = edge(np.minimum, x0, np.inf), edge(np.maximum, x1, -np.inf), edge(np.minimum, y0, np.inf), edge(np.maximum, y1, -np.inf)
    first, last = np.ceil(l) + 1, np.floor(r) - 1
    fine = (hi > lo) & (first <= last)
    # the places where another set of lines crosses
    xs = np.concatenate([first, np.ceil(x1), np.floor(x0) + 1])
    of = np.concatenate([np.arange(len(n)), page, page])
    keep = fine[of] & (xs >= first[of]) & (xs <= last[of])
    order = np.lexsort((xs[keep], of[keep]))
    xs, of = xs[keep][order], of[keep][order]
    new = np.ones(len(xs), bool)
    new[1:] = (xs[1:] != xs[:-1]) | (of[1:] != of[:-1])
    xs, of = xs[new], of[new]
    until = np.append(xs[1:], 0.0) - 1
    ends_page = np.append(of[1:] != of[:-1], True)[: len(of)]
    until[ends_page] = last[of[ends_page]]
    # a line without a top or bottom reaches to the page's own
    start, stop = np.where(np.isnan(y0), lo[page], y0), np.where(np.isnan(y1), hi[page], y1)
    by_top = np.lexsort((stop, start, page))
    pad = lambda v: np.append(v[by_top], np.nan)
    x0, y0, x1, y1, start, stop = map(pad, (x0, y0, x1, y1, start, stop))
    # rows of pages of like length go together
    rows, long = np.argsort(n[of], kind="stable"), n[of]
    bands = []
    at = 0
    while at < len(rows):
        some = rows[at : at + piece(long, rows, at)]
        at += len(some)
        p, x = of[some], xs[some][:, None]
        cols = np.arange(int(n[p].max()))
        i = np.where(cols < n[p][:, None], first_of[p][:, None] + cols, len(x0) - 1)
        left = x1[i] <= x
        right = ~left & (x0[i] >= x)
        enough = (left.sum(1) >= COLUMN_LINES) & (right.sum(1) >= COLUMN_LINES)
        if not enough.any():
            continue
        some, p, i, left, right = some[enough], p[enough], i[enough], left[enough], right[enough]
        across = ~left & ~right & (i < len(x0) - 1)
        s, e = start[i], stop[i]
        solid = across & (e > s)
        reached = np.maximum.accumulate(np.where(solid, e, -np.inf), axis=1)
        before = np.concatenate([np.full((len(some), 1), -np.inf), reached[:, :-1]], axis=1)
        before = np.where(np.isneginf(before), lo[p][:, None], before)
        half = ((hi - lo) * GUTTER_BAND)[p]
        with np.errstate(invalid="ignore"):
            row, col = np.nonzero(solid & (s > before) & (s - before >= half[:, None]))
        end = reached[:, -1]
        below = np.nonzero(solid.any(1) & (hi[p] > end) & (hi[p] - end >= half))[0]
        whole = np.nonzero(~across.any(1) & (hi[p] - lo[p] >= half))[0]
        row, top, bottom = np.concatenate([row, below, whole]), np.concatenate([before[row, col], end[below], lo[p[whole]]]), np.concatenate([s[row, col], hi[p[below]], hi[p[whole]]])
        for a in range(0, len(row), max(1, GUTTER_CELLS // len(cols))):
            part = slice(a, a + max(1, GUTTER_CELLS // len(cols)))
            k, t, u = row[part], top[part], bottom[part]
            ya, yb = y0[i[k]], y1[i[k]]
            beside = (yb > t[:, None]) & (ya < u[:, None])
            on_l, on_r = left[k] & beside, right[k] & beside
            nl, nr = on_l.sum(1), on_r.sum(1)
            low = lambda on: np.fmin.reduce(np.where(on, ya, np.inf), axis=1)  # noqa: E731, B023
            high = lambda on: np.fmax.reduce(np.where(on, yb, -np.inf), axis=1)  # noqa: E731, B023
            together = np.minimum(high(on_l), high(on_r)) - np.maximum(low(on_l), low(on_r)) >= ((hi - lo) * GUTTER_TOGETHER)[p[k]]
            ok = (nl >= COLUMN_LINES) & (nr >= COLUMN_LINES) & together
            bands.append((some[k[ok]], t[ok], u[ok], nl[ok], nr[ok]))
    if not bands:
        return np.zeros(0, "int64"), [np.zeros(0)] * 4 + [np.zeros(0, "int64")] * 2
    row, top, bottom, nl, nr = (np.concatenate(c) for c in zip(*bands))
    # the tallest band of an x, the topmost of equals; then runs of neighbouring x, and the tallest band of each
    order = np.lexsort((top, top - bottom, row))
    order = order[np.append(True, row[order][1:] != row[order][:-1])]
    row, top, bottom, nl, nr = (v[order] for v in (row, top, bottom, nl, nr))
    opens = np.append(True, (row[1:] != row[:-1] + 1) | (of[row[1:]] != of[row[:-1]]))
    run = np.cumsum(opens) - 1
    best = np.lexsort((xs[row], top - bottom, run))
    best = best[np.append(True, run[best][1:] != run[best][:-1])]
    closes = np.append(opens[1:], True)
    return of[row[opens]], [xs[row[opens]], until[row[closes]], top[best], bottom[best], nl[best].astype("int64"), nr[best].astype("int64")]
