"""Near-duplicates by DartMinHash over weighted word shingles.

An element of weight w owns a strip of width w. Every unit of an element's width has a Poisson stream of
darts, the same for all documents: rank by rank, each falls on one of K coordinates. A document's
signature keeps the earliest dart of each coordinate, so two documents agree there with probability equal
to their weighted Jaccard similarity, sum of minima over sum of maxima. Only about K ln K darts a document
are thrown, however long it is.

Bands of coordinates are joined by their hash. In a bucket, members are compared with its least member
first (a star, not all pairs) and checked exactly. In buckets that still hold several parts, what is not of
the largest part is compared with all in tiles: signatures alone say which members may be alike, only their
shingle sets are moved, and only links that join two parts go out. Classes are connected components of the
links, found by label propagation over the link table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_caches, fresh, materialize, mix64, release, small_batches, text_slices, windows_of, words_of
from .urlfilter import build_filter, probe

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 36, 6
K = BANDS * ROWS
#: Pairs whose signatures agree on less than this share are not checked (0.8 is 4 standard errors away).
SCREEN = 0.69
TILE = 1024
#: Up to so many names of candidates (8 bytes each) are broadcast to the sketches; more are shuffled.
BROADCAST_ROWS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def shingles(doc: np.ndarray, hashes: np.ndarray, n_docs: int, size: int = SHINGLE):
    """Distinct (text index, shingle hash, count), by text; a text of fewer words is one shingle of all."""
    at, h = windows_of(hashes, doc, size)
    owner = doc[at]
    counts = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.array([mix64(np.array([int(np.bitwise_xor.reduce(mix64(hashes[f : f + counts[s]] + np.arange(counts[s], dtype=np.uint64) * _GOLD)))], np.uint64))[0] for s, f in zip(short, first)], np.uint64)
        owner, h = np.concatenate([owner, short]), np.concatenate([h, extra])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return owner[starts], h[starts], np.diff(np.append(starts, len(h)))


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """(n_docs, k) 64-bit names of the earliest darts. Weights may be any positive numbers; texts without
    elements have zeros."""
    out = np.zeros((n_docs, k), np.uint64)
    # one strip of width up to 1 for each started unit of weight
    units = np.ceil(weights).astype(np.int64)
    strip_of = np.repeat(np.arange(len(units)), units)
    unit = np.arange(len(strip_of)) - np.repeat(np.cumsum(units) - units, units)
    seed = mix64(elements[strip_of] + (unit.astype(np.uint64) + _ONE) * _GOLD)
    width = np.minimum(1.0, weights[strip_of] - unit)
    strip_owner = owner[strip_of]
    total = np.bincount(owner, weights=weights, minlength=n_docs)
    todo = np.flatnonzero(total > 0)
    want = k * (np.log(k) + 3.5)
    while len(todo):
        reach = np.zeros(n_docs)
        reach[todo] = want / total[todo]
        mine = np.flatnonzero(reach[strip_owner] > 0)
        rank, sig = _throw(strip_owner[mine], seed[mine], width[mine], reach, todo, k)
        full = np.isfinite(rank).all(1)
        out[todo[full]] = sig[full]
        todo, want = todo[~full], want * 2  # an empty coordinate: throw further, the same darts come first
    return out


def _throw(owner, seed, width, reach, todo, k):
    place = np.zeros(len(reach), np.int64)
    place[todo] = np.arange(len(todo))
    limit = reach[owner]
    last, m, chunk = np.zeros(len(owner)), 0, 1
    cells, ranks, names = [], [], []
    live = np.arange(len(owner))
    while len(live):
        # the next darts of each strip: exponential gaps from hashed uniforms
        number = np.arange(m, m + chunk, dtype=np.uint64)
        h = mix64(seed[live, None] + (number[None, :] + _ONE) * _GOLD)
        gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        r = last[live, None] + np.cumsum(gap, axis=1)
        hit = r < limit[live, None]
        i, j = np.nonzero(hit)
        name = mix64(h[i, j] ^ _GOLD)
        rows = live[i]
        inside = (mix64(name) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < width[rows]
        rows, name, i, j = rows[inside], name[inside], i[inside], j[inside]
        cells.append(place[owner[rows]] * k + (name % np.uint64(k)).astype(np.int64))
        ranks.append(r[i, j])
        names.append(name)
        last[live] = r[:, -1]
        live = live[hit[:, -1]]
        m, chunk = m + chunk, min(chunk * 2, 64)
    cells, ranks, names = (np.concatenate(x) for x in (cells, ranks, names))
    best = np.full(len(todo) * k, np.inf)
    np.minimum.at(best, cells, ranks)
    first = ranks == best[cells]
    sig = np.zeros(len(todo) * k, np.uint64)
    sig[cells[first]] = names[first]
    return best.reshape(-1, k), sig.reshape(-1, k)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands' coordinates and number."""
    x = sig.reshape(len(sig), BANDS, ROWS)
    h = np.zeros(x.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
    for r in range(ROWS):
        h = mix64(h * _GOLD + x[:, :, r])
    return h


def units_of(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """32-bit names of each element's single units: similarity over them is weighted similarity over counts."""
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return (mix64(np.repeat(elements, counts) + copy.astype(np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, rep, sig, sets, bands) of each (doc_id, key, text): rep names the word sequence; sig has a byte a
    coordinate, which is enough to screen; sets the 32-bit units of the shingles; bands their 64-bit hashes.

    A text without words is named by its bytes and has no sets and bands."""

    def run(batches):
        import hashlib

        drop_caches()
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key")
            for lo, hi, data, offsets in text_slices(batch.column("text"), 1 << 20, 256):
                n = hi - lo
                _, _, doc, hashes = words_of(data, offsets)
                owner, element, count = shingles(doc, hashes, n)
                sig = signatures(owner, element, count.astype(np.float64), n)
                flat, who = units_of(element, count), np.repeat(owner, count)
                edge = np.searchsorted(who, np.arange(n + 1)).astype(np.int32)
                first = np.searchsorted(doc, np.arange(n))
                total = np.bincount(doc, minlength=n)
                placed = mix64(hashes + (np.arange(len(doc)) - first[doc]).astype(np.uint64) * _GOLD)
                run_of = np.concatenate([[np.uint64(0)], np.cumsum(placed)])
                rep = mix64(run_of[first + total] - run_of[first] + total.astype(np.uint64))
                empty = total == 0
                for i in np.flatnonzero(empty):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    rep[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, person=b"no words").digest(), "little")
                bands = bands_of(sig)
                ends = np.concatenate([[0], np.cumsum(np.where(empty, 0, BANDS))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, n), keys.slice(lo, n), pa.array(rep.view(np.int64)),
                    pa.array([None if e else x.tobytes() for x, e in zip(sig.astype(np.uint8), empty)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[~empty].ravel().view(np.int64))),
                ], names=["doc_id", "key", "rep", "sig", "sets", "bands"])
        drop_caches(trim=True)  # the worker idles through the joins that follow

    return docs.mapInArrow(run, "doc_id long, key long, rep long, sig binary, sets array<int>, bands array<long>")


def _star_check(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ok) for (a, b, sets_a, sets_b), row by row in the JVM, so that long texts never make a big batch."""
    both = F.size(F.array_intersect("sets_a", "sets_b"))
    alike = both / (F.size("sets_a") + F.size("sets_b") - both)
    return pairs.select("a", "b", (alike >= threshold).alias("ok"))


class _Parts:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        self.up[max(i, j)] = min(i, j)


def _sides(pdf):
    """A tile's members, and the positions of its two sides among them."""
    members = pdf.reset_index(drop=True)
    side = members["side"].to_numpy()
    return members, np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _suspects(key, pdf):
    """The rows of a tile of one bucket whose signature agrees with that of a row of another part."""
    members, left, right = _sides(pdf)
    sig = np.frombuffer(b"".join(members["sig"]), np.uint8).reshape(len(members), -1)
    _, part = np.unique(members["linked"].to_numpy(), return_inverse=True)
    found = np.zeros(len(members), bool)
    for i in left:
        other = right[part[right] != part[i]]
        near = other[np.count_nonzero(sig[other] == sig[i], axis=1) >= SCREEN * sig.shape[1]]
        found[near] = True
        found[i] |= len(near) > 0
    return members.loc[found, ["key", "x", "y", "rep", "side", "linked"]]


def _tile(threshold: float):
    """Links between the two sides of a tile of one bucket that join two parts; most alike pairs first."""

    def run(key, pdf):
        import pandas as pd

        drop_caches()
        members, left, right = _sides(pdf)
        rep = members["rep"].to_numpy()
        sig = np.frombuffer(b"".join(members["sig"]), np.uint8).reshape(len(members), -1)
        sets = [np.unique(x) for x in members["sets"]]
        parts, links = _Parts(len(members)), []
        star = {}
        for i, label in enumerate(members["linked"].to_numpy()):  # what the stars joined already
            parts.join(parts.find(i), parts.find(star.setdefault(label, i)))
        size = np.array([len(x) for x in sets])
        edge = np.concatenate([[0], np.cumsum(size)])
        _, unit, owners = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # two sets share at most what others here have of either: most pairs need no look at their units
        known = np.add.reduceat(owners[unit] > 1, edge[:-1]) if len(unit) else size
        mark = np.zeros(len(owners), bool)
        for i in left:
            most = np.minimum(known[right], known[i])
            agree = np.count_nonzero(sig[right] == sig[i], axis=1) / sig.shape[1]
            near = np.flatnonzero((agree >= SCREEN) & (most / (size[right] + size[i] - most) >= threshold))
            mark[unit[edge[i] : edge[i + 1]]] = True
            for q in near[np.argsort(-agree[near], kind="stable")]:
                j = int(right[q])
                if i != j and parts.find(i) != parts.find(j):
                    both = np.count_nonzero(mark[unit[edge[j] : edge[j + 1]]])
                    if both / (size[i] + size[j] - both) >= threshold:
                        parts.join(parts.find(i), parts.find(j))
                        links.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
            mark[:] = False
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _divided(members: DataFrame) -> DataFrame:
    """(key, _most, x_blocks, y_blocks) of the buckets of (key, rep, linked) that hold several parts: the largest
    part and the tiles for the rest and for all. Of buckets with the same members, known by two 64-bit sums, their
    number and their ends, one."""
    marks = [F.bit_xor(F.xxhash64("rep")).alias("m0"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("m1"), F.min("rep").alias("m2"), F.max("rep").alias("m3")]
    parts = members.groupBy("key", "linked").agg(F.count("*").alias("n"), *marks)
    largest = F.max(F.struct("n", "linked")).alias("_largest")
    found = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), largest, *[f(m).alias(m) for m, f in (("m0", F.bit_xor), ("m1", F.bit_xor), ("m2", F.min), ("m3", F.max))]).where("parts > 1")
    found = found.groupBy("n", "m0", "m1", "m2", "m3").agg(F.min(F.struct("key", "_largest")).alias("_one"))
    blocks = "cast(ceil(({}) / " + str(TILE) + ") as int)"
    return found.select("_one.key", F.col("_one._largest.linked").alias("_most"), F.expr(blocks.format("n - _one._largest.n")).alias("x_blocks"), F.expr(blocks.format("n")).alias("y_blocks"))


def _few(table: DataFrame, tag: str) -> DataFrame:
    """Written out, and broadcast where its counted rows (8 to 24 bytes each) are few."""
    table = materialize(table, tag)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _of(words: DataFrame, column: str, reps: DataFrame) -> DataFrame:
    """(rep, column) of the named word sequences, once each: only these are moved."""
    return materialize(words.select("rep", column).join(_few(reps.distinct(), "named"), "rep", "left_semi").dropDuplicates(["rep"]), column)


def _more_links(state: DataFrame, sigs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the parts of divided buckets, from their members (key, rep, linked).

    Members of all parts but the largest are compared with all members, in tiles of up to TILE by TILE: first
    by signatures, which decide what is checked, then by the sets of those that may be alike. ``side`` of a row
    is 0, 1 or 2 for both."""
    state = state.join(materialize(_divided(state), "open"), "key")
    block = "cast(pmod(xxhash64(rep), {}) as int)"
    state = state.withColumns({"_x": F.expr(block.format("x_blocks")), "_y": F.expr(block.format("y_blocks")), "_rest": F.expr("linked != _most")})
    left = state.where("_rest").select("key", F.col("_x").alias("x"), F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1)).alias("y"), "rep", "linked", "_y")
    left = left.select("key", "x", "y", "rep", F.when(F.col("y") == F.col("_y"), 2).otherwise(0).alias("side"), "linked")
    right = state.select("key", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1)).alias("x"), F.col("_y").alias("y"), "rep", "linked", "_x", "_rest").where("NOT (_rest AND x = _x)")
    tiles = left.unionByName(right.select("key", "x", "y", "rep", F.lit(1).alias("side"), "linked"))
    tiles = tiles.join(sigs, "rep").select("key", "x", "y", "rep", "side", "linked", "sig")
    suspects = materialize(tiles.groupBy("key", "x", "y").applyInPandas(_suspects, "key long, x int, y int, rep long, side int, linked long"), "suspects")
    sets = _of(words, "sets", suspects.select("rep"))
    tiles = suspects.join(sigs, "rep").join(sets, "rep").select("key", "x", "y", "rep", "side", "linked", "sig", "sets")
    more = materialize(tiles.groupBy("key", "x", "y").applyInPandas(_tile(threshold), "a long, b long"), "more")
    release(sets, suspects)
    return more


def components(links: DataFrame) -> DataFrame:
    """(node, label) for nodes of (a, b): label is the least node of the component.

    Each round every node takes the least label of its neighbours and then its label's label; rounds
    grow with the logarithm of a chain's length. Tables are written between rounds."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node", "left").select("node", F.least("label", "near").alias("new"), "label")
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("root"))
        step = materialize(step.join(jump, "new", "left").select("node", F.least("new", "root").alias("label"), F.col("label").alias("old")), "labels")
        labels = step.select("node", "label")
        if step.where("label != old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, class_size, first), one for each row of docs.

    Texts with the same word sequence (ASCII case and punctuation aside) are copies; texts are linked if
    the weighted Jaccard similarity of their 5-word shingles is at least ``threshold``; classes are
    connected by links. ``class_id`` is the class's least doc_id; ``first`` marks its rows of the text that
    stays, which are one row unless that row is repeated. Texts without words are copies only if equal; null
    counts as empty. Null ids come after others; repeated rows are copies; an empty table gives no rows; other
    columns are ignored.
    """
    return _classes(docs, threshold).drop("key")


def _text_key(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _shared(words: DataFrame) -> DataFrame:
    """(key, rep, leader): members of the buckets that at least two texts share, and the least of each.

    Most buckets hold one text: a Bloom filter of the shared ones keeps those from the second shuffle."""
    spark = words.sparkSession
    banded = words.select("rep", F.explode("bands").alias("key"))
    least = materialize(banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("_last")).where("leader != _last").drop("_last"), "buckets")
    blocks = spark.sparkContext.broadcast(build_filter(least, hashed=True))

    def run(batches):
        for batch in batches:
            rep, bands = batch.column("rep"), batch.column("bands")
            flat = bands.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), bands.value_lengths().to_numpy())
            at = np.flatnonzero(probe(blocks.value, flat))
            yield pa.RecordBatch.from_arrays([pa.array(rep.to_numpy()[row[at]]), pa.array(flat[at])], names=["rep", "key"])

    hits = words.select("rep", "bands").mapInArrow(run, "rep long, key long").distinct()
    members = materialize(hits.join(least, "key").select("key", "rep", "leader"), "members")
    release(least)
    return members


def _checked(pairs: DataFrame, sigs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of at least ``threshold``. Signatures rule out most of the others before the shingle
    sets are moved; an a of many is dealt to as many tasks as its pairs need, most have a few."""

    def beside(pairs, other, column):
        leads = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("salts"))
        pairs = pairs.join(leads, "a").select("a", "b", F.pmod(F.hash("b"), F.col("salts")).alias("_salt"))
        with_b = other.select(F.col("rep").alias("b"), F.col(column).alias(f"{column}_b")).join(_few(pairs, "dealt"), "b")
        leaders = other.select(F.col("rep").alias("a"), F.col(column).alias(f"{column}_a")).join(leads, "a").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
        return with_b.join(leaders, ["a", "_salt"])

    def screen(batches):
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, K) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= SCREEN))

    near = materialize(beside(pairs, sigs, "sig").select("a", "b", "sig_a", "sig_b").mapInArrow(screen, "a long, b long"), "screened")
    sets = _of(words, "sets", near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))))
    links = materialize(_star_check(beside(near, sets, "sets"), threshold).where("ok").select("a", "b"), "stars")
    release(sets, near)
    return links


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """near_duplicates with a key of the text."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _text_key(docs).alias("key"), docs["text"])
    sketched = materialize(_sketches(rows), "sketches")
    # copies share a name; what follows sees each word sequence once
    words = sketched.where(F.size("bands") > 0)
    members = _shared(words)
    stars = materialize(members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    sigs = _of(words, "sig", stars.select(F.col("a").alias("rep")).unionByName(stars.select(F.col("b").alias("rep"))))
    links = _checked(stars, sigs, words, threshold)

    # buckets of three and more whose members the stars left in several parts
    part = components(links)
    state = members.select("key", "rep").join(part.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("linked"))
    many = members.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 2").select("key")
    more = _more_links(materialize(state.join(many, "key", "left_semi"), "state"), sigs, words, threshold)

    # parts that further links join, and so the class of each text
    ends = more.join(part.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(part.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b"))
    label = part.select("node", "label").unionByName(joined.select("node", F.col("node").alias("label")).join(part.select("node"), "node", "left_anti"))
    label = label.join(joined.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left").select(F.col("node").alias("rep"), F.coalesce("_to", "label").alias("label"))
    keyed = sketched.select("doc_id", "key", "rep")
    classed = materialize(keyed.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")).select("doc_id", "key", "label"), "classed")
    release(sketched, sigs, members, stars)
    own = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("key"))
    # written, so that the join below sees plain tables, whose hot labels Spark can split
    groups = materialize(classed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(own).alias("_least")), "classes")
    return classed.join(groups, "label").select("doc_id", "key", "class_id", "class_size", own.eqNullSafe(F.col("_least")).alias("first"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the first of near_duplicates, with its own columns."""
    classes = materialize(_classes(docs, threshold), "classes")
    id_, key, gone_id, gone_key = fresh(docs.columns, "_id", "_key", "_gone_id", "_gone_key")
    gone = materialize(classes.where("NOT first").select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    keyed = docs.withColumns({key: _text_key(docs), id_: docs["doc_id"].cast("long")})
    once = keyed.join(gone, F.col(id_).eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    # rows that repeat both id and text are all first; texts are shuffled only if there are any
    again = classes.where("first").groupBy("doc_id", "key").count().where("count > 1")
    return (once if again.isEmpty() else once.dropDuplicates([id_, key])).select(*docs.columns)
