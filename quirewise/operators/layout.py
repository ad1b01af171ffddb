"""Words, cells, rows and blocks of lines, and layouts that can't be read in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, horizontal_overlap, hull, overlap_ratio
from ..functions.text import bracket_depth, is_blank
from .stats import horizontal, piece

# Thresholds of the layout rules.
BASELINE_SHIFT, STYLE_GAP, LINK_SHARE = 0.3, 0.25, 0.5
OVERLAP_TEXT, IN_GRAPHICS, FULL_PAGE, RULE_EDGE, TABLE_RULES, NESTED_WIDTH = 0.5, 0.9, 0.7, 2.0, 3, 0.9
MIN_GAP, BRACKET_HEIGHTS, BRACKET_LINES = -2.0, 3.0, 3
LINE = ["doc_id", "page", "line_no"]


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs from 0: a row where ``breaks`` holds (it may use lag over the same window) opens one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_b")


def words(tokens: DataFrame, word_gap: Column) -> DataFrame:
    """(doc_id, page, line_no, word, text, bbox, size, bold) from glyph tokens (.., span_no, tok_no, text, bbox,
    origin_y, font, size, bold, char_width).

    A space glyph ends a word and joins none; so does a gap, a shifted baseline, or a change of style with
    some gap. Overlapping glyphs never part."""
    w = Window.partitionBy(*LINE).orderBy("span_no", "tok_no")
    space = is_blank(F.col("text"))
    prev = lambda c: F.lag(c).over(w)
    gap = F.col("bbox.x0") - prev("bbox")["x1"]
    limit = F.when(F.col("char_width") > 0, F.when(word_gap > 0, F.least(word_gap, F.col("char_width") * 0.5)).otherwise(F.col("char_width") * 0.5)).otherwise(word_gap)
    shift = F.abs(F.col("origin_y") - prev("origin_y")) > F.col("size") * BASELINE_SHIFT
    style = (F.col("font") != prev("font")) | (F.abs(F.col("size") - prev("size")) > 0.1) | (F.col("bold") != prev("bold"))
    parts = (gap >= 0) & (F.coalesce(shift & (F.col("size") > 0), F.lit(False)) | ((limit > 0) & (gap >= limit)) | (style & (F.col("char_width") > 0) & (gap >= F.col("char_width") * STYLE_GAP)))
    breaks = space | prev("text").isNull() | is_blank(prev("text")) | parts
    # only visible glyphs count as islands: a space's own island is dropped
    run = islands(tokens, LINE, ["span_no", "tok_no"], breaks, "run").where(~space)
    out = run.groupBy(*LINE, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "tok_no", "text"))), lambda t: t["text"]), "").alias("text"), hull().alias("bbox"), F.min_by("size", F.struct("span_no", "tok_no")).alias("size"), F.min_by("bold", F.struct("span_no", "tok_no")).alias("bold"))
    return out.withColumn("word", F.row_number().over(Window.partitionBy(*LINE).orderBy("run")) - 1).drop("run")


def cells(words_df: DataFrame, cell_gap: Column) -> DataFrame:
    """Groups of a line's words; a gap of at least ``cell_gap`` (if any is set) opens one."""
    w = Window.partitionBy(*LINE).orderBy("word")
    breaks = F.lag("word").over(w).isNull() | ((cell_gap > 0) & (F.col("bbox.x0") - F.lag("bbox").over(w)["x1"] >= cell_gap))
    run = islands(words_df, LINE, ["word"], breaks, "cell")
    return run.groupBy(*LINE, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda t: t["text"]), " ").alias("text"), hull().alias("bbox"), F.count("*").alias("words"))


def baselines(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """A line's baseline: the median of its glyphs' origins, else its lower edge."""
    found = tokens.groupBy(*LINE).agg(F.median("origin_y").alias("_o"))
    return lines.join(found, LINE, "left").withColumn("baseline", F.coalesce("_o", F.col("bbox.y1"))).drop("_o")


def visual_rows(lines: DataFrame, tolerance: str, gutters: str | None = None) -> DataFrame:
    """(doc_id, row, line_index, ...): lines side by side make a row.

    In (page, top, left) order a line joins the current row if its baseline is within tolerance of the row's
    running median and no gutter parts them. The running median makes this a fold over the document's lines;
    ``tolerance`` and ``gutters`` name columns of ``lines``.
    """
    cols = [F.col("page"), F.col("bbox.y0").alias("y0"), F.col("bbox.x0").alias("x0"), F.col("line_index"), F.col("baseline"), F.col("bbox.x1").alias("x1"), F.col("text")]
    packed = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("all"), F.max(tolerance).alias("tol"), *([F.first(gutters).alias("gut")] if gutters else []))
    start = F.struct(F.lit(-1).alias("page"), F.lit(-1).alias("row"), F.expr("cast(array() as array<double>)").alias("bases"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"), F.expr("cast(array() as array<int>)").alias("rows"))

    def median(a):
        s, n = F.array_sort(a), F.size(a)
        half = F.floor(n / 2).cast("int")
        return F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)

    def step(s, line):
        parted = F.lit(False)
        if gutters:
            a0, a1 = F.least(s["x0"], line["x0"]), F.when(s["x0"] <= line["x0"], s["x1"]).otherwise(line["x1"])
            b0 = F.when(s["x0"] <= line["x0"], line["x0"]).otherwise(s["x0"])
            parted = F.coalesce(F.exists(F.col("gut"), lambda g: (g["page"] == line["page"]) & (a1 <= g["left"]) & (b0 >= g["right"]) & (a0 <= a1)), F.lit(False))
        same = (s["page"] == line["page"]) & (F.col("tol") > 0) & (F.size(s["bases"]) > 0) & (F.abs(line["baseline"] - median(s["bases"])) <= F.col("tol")) & ~parted
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(
            line["page"].cast("int").alias("page"), row.alias("row"), F.when(same, F.array_append(s["bases"], line["baseline"])).otherwise(F.array(line["baseline"])).alias("bases"),
            F.when(same, F.least(s["x0"], line["x0"])).otherwise(line["x0"]).alias("x0"), F.when(same, F.greatest(s["x1"], line["x1"])).otherwise(line["x1"]).alias("x1"), F.array_append(s["rows"], row).alias("rows"),
        )

    rows = F.aggregate("all", start, step, lambda s: s["rows"])
    both = packed.select("doc_id", F.explode(F.zip_with("all", rows, lambda line, r: F.struct(r.alias("row"), line.alias("line")))).alias("z"))
    return both.select("doc_id", "z.row", "z.line.line_index", "z.line.page", "z.line.x0", "z.line.text")


def stated_rows(lines: DataFrame) -> DataFrame:
    """Rows that the source states: neighbouring lines of one (table, row); every other line is its own."""
    w = Window.partitionBy("doc_id").orderBy("line_index")
    same = F.col("tbl").isNotNull() & (F.lag("tbl").over(w) == F.col("tbl")) & (F.lag("row").over(w) == F.col("row"))
    return islands(lines, ["doc_id"], ["line_index"], ~F.coalesce(same, F.lit(False)), "row_no")


def row_values(rows: DataFrame) -> DataFrame:
    """One record a row: its cells from left to right."""
    return rows.groupBy("doc_id", "row").agg(F.min("page").alias("page"), F.transform(F.array_sort(F.collect_list(F.struct("x0", "line_index", "text"))), lambda c: F.struct(c["text"].alias("text"), c["line_index"].alias("line_index"))).alias("cells"))


def continues(gap: Column, paragraph_gap: Column, line_height: Column, text: Column) -> Column:
    """Whether a line this far below continues a block: a small gap does, and so does a bracket still open, for
    three line heights and three lines."""
    since = F.length(F.regexp_replace(_after_open_bracket(text), r"[^\n]", ""))
    return (gap >= MIN_GAP) & ((gap <= paragraph_gap) | ((bracket_depth(text) > 0) & (gap <= F.greatest(line_height, F.lit(1.0)) * BRACKET_HEIGHTS) & (since < BRACKET_LINES)))


def _after_open_bracket(text: Column) -> Column:
    """The text from the outermost bracket that is still open; empty if none is."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(s, c):
        opens, closes = c.isin("(", "["), c.isin(")", "]")
        depth = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        at = F.when(opens & (s["depth"] == 0), s["i"] + 1).when(closes & (depth == 0), 0).otherwise(s["at"])
        return F.struct(depth.alias("depth"), at.alias("at"), (s["i"] + 1).alias("i"))

    at = F.aggregate(F.split(text, ""), state, step, lambda s: s["at"])
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise("")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, block, page, text, lines): lines folded into blocks.

    ``lines`` has doc_id, line_index, page, text, bbox, paragraph_gap, line_height. A line continues the block
    above on the same page if ``continues`` says so and the two share some width. What the block holds so far
    decides about open brackets, so this is a fold."""
    item = F.struct("line_index", "page", "text", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"), F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))
    packed = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"), F.max("paragraph_gap").alias("pg"), F.max("line_height").alias("lh"))
    block = "struct<page:int,text:string,x0:double,x1:double,y0:double,y1:double,lines:int>"
    start = F.expr(f"cast(array() as array<{block}>)")

    def step(out, li):
        last = F.element_at(out, -1)
        on = (F.size(out) > 0) & (last["page"] == li["page"]) & continues(li["y0"] - last["y1"], F.col("pg"), F.col("lh"), last["text"]) & (F.least(last["x1"], li["x1"]) > F.greatest(last["x0"], li["x0"]))
        fresh = F.struct(li["page"].cast("int").alias("page"), li["text"].alias("text"), li["x0"].alias("x0"), li["x1"].alias("x1"), li["y0"].alias("y0"), li["y1"].alias("y1"), F.lit(1).alias("lines"))
        grown = F.struct(last["page"].alias("page"), F.concat(last["text"], F.lit("\n"), li["text"]).alias("text"), li["x0"].alias("x0"), li["x1"].alias("x1"), li["y0"].alias("y0"), li["y1"].alias("y1"), (last["lines"] + 1).alias("lines"))
        return F.when(F.coalesce(on, F.lit(False)), F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), grown)).otherwise(F.array_append(out, fresh))

    blocks = packed.select("doc_id", F.posexplode(F.aggregate("all", start, step)).alias("block", "b"))
    return blocks.select("doc_id", "block", "b.page", "b.text", "b.lines")


def linked_words(words_df: DataFrame, links: DataFrame) -> DataFrame:
    """Words with the uri of the first link that covers half of their area, null without one."""
    keys = ["doc_id", "page"]
    wide = F.struct(*[(F.col(f"rect.{c}") + d).alias(c) for c, d in (("x0", -2.0), ("y0", -2.0), ("x1", 2.0), ("y1", 2.0))])
    on = words_df.join(links.select(*keys, "link_no", "uri", wide.alias("rect")), keys)
    b, r = F.col("bbox"), F.col("rect")
    shared = horizontal_overlap(b, r) * F.greatest(F.lit(0.0), F.least(b["y1"], r["y1"]) - F.greatest(b["y0"], r["y0"]))
    hit = on.where((area(b) > 0) & (shared >= area(b) * LINK_SHARE)).groupBy(*LINE, "word").agg(F.min_by("uri", "link_no").alias("uri"))
    return words_df.join(hit, [*LINE, "word"], "left")


def link_lines(links: DataFrame, lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(doc_id, page, link_no, uri, line_index): the line of each web link. Lines that its box touches come
    before those within tolerance; of equals the one with the nearest middle."""
    keys = ["doc_id", "page"]
    web = links.where(~F.lower("uri").rlike("^(mailto|tel):"))
    pair = web.select(*keys, "link_no", "uri", "rect").join(lines.select(*keys, "line_index", "bbox"), keys)
    b, r = F.col("bbox"), F.col("rect")
    touch = lambda t: (b["x0"] < r["x1"] + t) & (r["x0"] - t < b["x1"]) & (b["y0"] < r["y1"] + t) & (r["y0"] - t < b["y1"])
    rank = F.struct(F.when(touch(0.0), 0).otherwise(1), F.abs((b["y0"] + b["y1"]) / 2 - (r["y0"] + r["y1"]) / 2), F.col("line_index"))
    return pair.where(touch(tolerance)).groupBy(*keys, "link_no", "uri").agg(F.min_by("line_index", rank).alias("line_index"))


def vertical_text(lines: DataFrame) -> DataFrame:
    turned = lines.where(~horizontal() & ~is_blank(F.col("text")))
    out = turned.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min_by("bbox", "line_no").alias("bbox"))
    return out.select("doc_id", "page", F.lit("vertical_text").alias("kind"), F.concat(F.col("n").cast("string"), F.lit(" line(s) are not set horizontally")).alias("detail"), "bbox")


def overlapping_text(lines: DataFrame) -> DataFrame:
    """The first pair of lines on each page that cover each other by half."""
    line = F.struct("line_no", "text", "bbox")
    return page_overlaps(lines.groupBy("doc_id", "page").agg(F.collect_list(line).alias("lines")))


def page_overlaps(pages: DataFrame) -> DataFrame:
    """``overlapping_text`` of pages (doc_id, page, lines): a page's pairs stay in the memory of one task, in pieces of
    ``stats.GUTTER_CELLS``, and only the first one leaves it."""
    keys = ["doc_id", "page"]
    corner = lambda x, c: x["bbox"][c].cast("double").alias(c)
    full = F.transform(F.filter("lines", lambda x: ~is_blank(x["text"])), lambda x: F.struct(x["line_no"], *[corner(x, c) for c in ("x0", "y0", "x1", "y1")]))
    some = pages.select(*keys, F.array_sort(full).alias("lines")).where("size(lines) > 1")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.select(*keys).schema)
    no = some.schema["lines"].dataType.elementType["line_no"].dataType.simpleString()
    hit = some.mapInArrow(_first_overlaps, f"{kinds}, first {no}, second {no}, x0 double, y0 double, x1 double, y1 double")
    return hit.select(*keys, F.lit("overlapping_text").alias("kind"), F.concat_ws(" ", F.lit("lines"), "first", F.lit("and"), "second", F.lit("cover each other")).alias("detail"), F.struct("x0", "y0", "x1", "y1").alias("bbox"))


def _first_overlaps(batches):
    """Rows are lines, columns the lines of their page; lines come in order of their number."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        ends, flat = b.column("lines").offsets.to_numpy(), b.column("lines").values
        flat, ends = flat.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]
        n = np.diff(ends)
        page = np.repeat(np.arange(len(n)), n)
        no = flat.field("line_no")
        rank = np.unique(no.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        x0, y0, x1, y1 = (np.append(flat.field(c).to_numpy(zero_copy_only=False), np.nan) for c in ("x0", "y0", "x1", "y1"))
        size = np.maximum(0.0, x1 - x0) * np.maximum(0.0, y1 - y0)
        rank = np.append(rank, -1)
        long = n[page]
        rows = np.argsort(long, kind="stable")
        first, second = [], []
        at = 0
        while at < len(rows):
            some = rows[at : at + piece(long, rows, at)]
            at += len(some)
            p, cols = page[some], np.arange(int(n[page[some]].max()))
            i = np.where(cols < n[p][:, None], ends[p][:, None] + cols, len(flat))
            k = some[:, None]
            shared = np.maximum(0.0, np.minimum(x1[k], x1[i]) - np.maximum(x0[k], x0[i])) * np.maximum(0.0, np.minimum(y1[k], y1[i]) - np.maximum(y0[k], y0[i]))
            small = np.minimum(size[k], size[i])
            with np.errstate(divide="ignore", invalid="ignore"):
                on = (rank[k] < rank[i]) & (small > 0) & (shared / small >= OVERLAP_TEXT)
            any_ = on.any(1)
            first.append(some[any_])
            second.append(i[any_, on[any_].argmax(1)])
        first, second = (np.concatenate(c) if c else np.zeros(0, "int64") for c in (first, second))
        order = np.argsort(first)
        order = order[np.append(True, np.diff(page[first[order]]) != 0)[: len(order)]]
        first, second = first[order], second[order]
        columns = [b.column(k).take(pa.array(page[first])) for k in ("doc_id", "page")] + [no.take(pa.array(first)), no.take(pa.array(second))] + [pa.array(v[first]) for v in (x0, y0, x1, y1)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page", "first", "second", "x0", "y0", "x1", "y1"])


def text_in_graphics(lines: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """The first image of each page, smaller than most of it, that holds lines; scanned pages are left out."""
    keys = ["doc_id", "page"]
    page = pages.where(~F.coalesce("used_ocr", F.lit(False)) & (F.col("width") > 0) & (F.col("height") > 0)).select(*keys, (F.col("width") * F.col("height")).alias("whole"))
    small = images.join(page, keys).where(area(F.col("region")) < F.col("whole") * FULL_PAGE).select(*keys, "region_no", "region")
    hit = lines.where(~is_blank(F.col("text"))).select(*keys, "bbox").join(small, keys).where(overlap_ratio(F.col("bbox"), F.col("region")) >= IN_GRAPHICS)
    by = hit.groupBy(*keys, "region_no").agg(F.count("*").alias("n"), F.first("region").alias("region"))
    out = by.groupBy(*keys).agg(F.min_by(F.struct("n", "region"), "region_no").alias("p"))
    return out.select(*keys, F.lit("text_in_graphics").alias("kind"), F.concat(F.col("p.n").cast("string"), F.lit(" line(s) sit inside an image region")).alias("detail"), F.col("p.region").alias("bbox"))


def nested_tables(rules: DataFrame) -> DataFrame:
    """Pages where a horizontal rule lies inside a grid of three rules with the same ends, short of its width."""
    keys = ["doc_id", "page"]
    flat = rules.where("orientation = 'horizontal'").withColumn("e0", F.bround(F.col("bbox.x0") / RULE_EDGE, 0)).withColumn("e1", F.bround(F.col("bbox.x1") / RULE_EDGE, 0))
    grid = flat.groupBy(*keys, "e0", "e1").agg(F.count("*").alias("n"), hull().alias("g")).where(f"n >= {TABLE_RULES} and g.x1 > g.x0").withColumnsRenamed({"e0": "g0", "e1": "g1"})
    b, g = F.col("bbox"), F.col("g")
    inside = flat.join(grid, keys).where(~((F.col("e0") == F.col("g0")) & (F.col("e1") == F.col("g1"))) & (g["y0"] < b["y0"]) & (b["y1"] < g["y1"]) & (b["x0"] >= g["x0"]) & (b["x1"] <= g["x1"]) & (b["x1"] - b["x0"] < (g["x1"] - g["x0"]) * NESTED_WIDTH))
    out = inside.groupBy(*keys).agg(F.min_by("bbox", F.struct("g.y0", "bbox.y0")).alias("bbox"))
    return out.select(*keys, F.lit("nested_table").alias("kind"), F.lit("a rule sits inside a table grid").alias("detail"), "bbox")


def column_warnings(gutters: DataFrame) -> DataFrame:
    detail = F.concat_ws(" ", F.lit("gutter at"), F.col("left").cast("int"), F.lit("to"), F.col("right").cast("int"), F.lit("between"), F.col("left_lines"), F.lit("and"), F.col("right_lines"), F.lit("lines"))
    box = F.struct(F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"))
    return gutters.select("doc_id", "page", F.lit("multiple_columns").alias("kind"), detail.alias("detail"), box.alias("bbox"))


def unsupported_layouts(lines: DataFrame, pages: DataFrame, images: DataFrame, rules: DataFrame, gutters: DataFrame, overlaps: DataFrame | None = None) -> DataFrame:
    """All reasons (doc_id, page, kind, detail, bbox) why a page's reading order may be a guess; a report sorts
    them within each document. ``overlaps`` brings overlapping text that is already found."""
    parts = [column_warnings(gutters), vertical_text(lines), overlapping_text(lines) if overlaps is None else overlaps, text_in_graphics(lines, images, pages), nested_tables(rules)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
