"""The corpus operators against brute force on small fixtures, and on odd rows."""

import collections
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quirewise.llm import dartminhash, decontaminate, disclosure, kdtree, license_scan, quality, queries, raking, sstable, urlfilter, vamana

ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "lost words without an id here", "en", None, 5),
    (3, "the same text of words for copies", "en", "a", 33), (4, "the same text of words for copies", "de", "b", 33), (5, "the same text of words for copies", "de", "b", None),
    (6, "!!! ???", "en", "a", 7), (7, "é" * 50 + "\n\ufeff\u200b  \n x  ", "fr", "c", 60), (8, "x" * 300_000, "en", "a", 300_000), (9, "word " * 60_000, "en", "a", 300_000), (-5, "negative id", "en", "a", 11),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("shard", "size", "spans", "score", "rep", "_row", "class_id", "topic", "tokens", "weight", "h", "at", "start", "held_out", "_t", "key", "_id", "_key", "_probability", "_source", "_gone_id")


def odd(spark, rows=ODD):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


# 1 sharding
def check_shards(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))


def test_kdtree_shards(spark, sf_dir, texts):
    rows = queries.op1_kdtree_sharding(spark, sf_dir).collect()
    want = {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want and len(rows) == len(want)
    check_shards(rows, 24)
    sums = collections.Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    mean = sum(sums.values()) / 24
    longest = max(r["size"] for r in rows)
    assert len(sums) == 24 and max(abs(v - mean) for v in sums.values()) <= longest


def test_kdtree_splits_hot_group_and_odd_rows(spark):
    from pyspark.sql import functions as F

    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("copy " * 20).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(100).cast("long").alias("n_chars"))
    rows = kdtree.kdtree_shards(hot, shards=5).collect()
    assert max(collections.Counter(r["shard"] for r in rows).values()) <= 610
    check_shards(rows, 5)
    same = kdtree.kdtree_shards(hot.withColumn("doc_id", F.lit(7).cast("long")), shards=4).collect()
    assert max(collections.Counter(r["shard"] for r in same).values()) <= 760
    rows = kdtree.kdtree_shards(odd(spark), shards=3).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((x[0] is None, x[0] or 0) for x in ODD)
    check_shards(rows, 3)
    assert kdtree.kdtree_shards(odd(spark, []), shards=3).count() == 0
    with pytest.raises(ValueError):
        kdtree.kdtree_shards(hot)
    assert len({r["shard"] for r in kdtree.kdtree_shards(hot, target_bytes=50_000).collect()}) == round(3000 * 108 / 50_000)


# 2 licenses
def brute_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in license_scan.BASE for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = sorted(i for i, _ in found)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))


def test_license_base_matches_brute_force(spark, sf_dir, texts):
    rows = queries.op2_license_notices(spark, sf_dir).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows}
    assert got == {d: brute_license(t) for d, t in texts} and any(v[1] for v in got.values())
    for r in rows:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_fuzzy_and_odd_rows(spark):
    rows = [*ODD, (50, "x. Relased under teh MIT License, y", "en", "a", 1), (51, "Under the mit license: cc by nc; UNDER THE MIT LICENSE", "en", "a", 1), (52, "GNU Genral Public Licence, version 3", "en", "a", 1), (53, "the weather is nice and a license was not given", "en", "a", 1)]
    got = {}
    for r in license_scan.license_notices(odd(spark, rows)).collect():
        got.setdefault(r["doc_id"], r)
    assert len(got) == len({x[0] for x in rows})
    assert got[50]["labels"] == "mit" and got[50]["n_base"] == 0 and 0.8 < got[50]["score"] < 1
    span = got[50]["spans"][0]
    assert (span["first"], span["words"], span["text"]) == (1, 5, "relased under teh mit license")
    assert (got[51]["n_base"], got[51]["first_word"], got[51]["last_word"], got[51]["base_labels"]) == (3, 0, 7, "cc-by-nc,mit")
    assert got[52]["labels"] == "gpl-3" and got[53]["labels"] == "" and got[53]["score"] == 0
    for doc, text, *_ in rows:
        if doc not in (2, None):
            r = got[doc]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(text)
    assert license_scan.license_notices(odd(spark, [])).count() == 0


def brute_fuzzy(text):
    """Labels of notices that some window of whole words is within the allowed edits of, telling words exact."""
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
    out = set()
    for phrase, label in license_scan.NOTICES:
        k, size, wanted = license_scan.allowed(phrase, 0.1), len(phrase.split()), [w.decode() for w in license_scan.telling(phrase)]
        for i in range(len(words)):
            for n in range(max(1, size - 2), size + 3):
                window = words[i : i + n]
                flat, row = " ".join(window), range(len(phrase) + 1)
                if len(window) < n or abs(len(flat) - len(phrase)) > k or not license_scan.holds(window, wanted):
                    continue
                for c in flat:
                    new = [row[0] + 1]
                    for j, p in enumerate(phrase):
                        new.append(min(row[j] + (c != p), row[j + 1] + 1, new[j] + 1))
                    row = new
                if row[-1] <= k:
                    out.add(label)
    return out


def test_license_labels_match_brute_force():
    rng = np.random.default_rng(5)
    scanner, found = license_scan.Scanner(), 0
    for phrase, _ in license_scan.NOTICES * 12:
        text = list(phrase)
        for _ in range(rng.integers(0, license_scan.allowed(phrase, 0.1) + 2)):
            at = rng.integers(0, len(text))
            text[at : at + rng.integers(0, 2)] = [str(rng.choice(list("abcdefgh")))] * rng.integers(0, 2)
        text = f"some words before {''.join(text)} and words after"
        got = {s["label"] for s in scanner.scan(text)[3]}
        assert got == brute_fuzzy(text), text
        found += bool(got)
    assert found > 80
    for text in ("licensed under cc by nd", "gnu general public license version 1", "apache license version 1 0", "mozilla public license version 1 1", "all rights preserved", "gnu general public license version"):
        assert scanner.scan(f"x {text} y")[2:] == (set(), []), text


# 3 quality
def test_quality_on_held_out_rows(spark, sf_dir, duck):
    rows = queries.op3_quality_classifier(spark, sf_dir).collect()
    label = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    scored = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good, bad = [s for s, y in scored if y], [s for s, y in scored if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.97
    right = np.mean([(s >= 0.3) == bool(y) for s, y in scored])
    assert right >= 0.95


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    train = spark.createDataFrame([(i, "clean prose with words" if i % 2 else "buy $$$ now %%% !!!", None, None, None) for i in range(60)], SCHEMA)
    model = quality.fit(train, labels)
    rows = quality.score_quality(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    alone = {d: model.score(t or "") for d, t, *_ in ODD if d is not None}
    assert all(abs(r["score"] - alone[r["doc_id"]]) < 1e-9 for r in rows if r["doc_id"] is not None)
    assert model.score("clean prose") > 0.5 > model.score("now $$$ %%%")
    assert quality.score_quality(odd(spark, []), model).count() == 0
    assert 0 <= quality.fit(train, labels.where("doc_id < 0")).score("x") <= 1
    kept = quality.keep_quality(odd(spark), model)
    assert kept.columns == odd(spark).columns


def test_quality_features_do_not_depend_on_pieces(monkeypatch):
    text = "some words in a text\nwith\tspaces and ünïcode " * 40
    whole = sorted(quality.features(text))
    monkeypatch.setattr(quality, "_PIECE", 50)
    assert sorted(quality.features(text)) == whole


# 4 decontamination
def test_contamination_matches_brute_force(spark, sf_dir, duck, texts):
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_template_decontamination(spark, sf_dir).collect()}
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = {i: words(t) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()}
    whole = set()
    for d, t in texts:
        flat = " " + " ".join(words(t)) + " "
        whole |= {(d, i) for i, w in items.items() if f" {' '.join(w)} " in flat}
    assert whole and whole <= got and len(got - whole) <= 2


def test_contamination_of_changed_values(spark):
    item = "Alice walked from Boston with 12 apples and 5 km later she gave Robert 12 of them , how many apples did Alice have left after 5 km of walking"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one")], "item_id long, text string")
    swapped = item.replace("12", "37").replace("Boston", "Denver").replace("Alice", "Maria").replace("Robert", "Peter").replace("5 km", "9 miles")
    broken = item.replace("12 of", "99 of")
    rows = [*ODD, (60, "Intro words, " + item + " end.", "en", "a", 1), (61, "Other text; then " + swapped + " end", "en", "a", 1), (62, "We know " + broken, "en", "a", 1), (63, "apples and 5 km later she gave", "en", "a", 1)]
    got = {r["doc_id"]: r for r in decontaminate.contaminated(odd(spark, rows), bench).collect()}
    # 62 has one number that conflicts, but 14 words before and 14 after it are the item's
    assert set(got) == {60, 61, 62} and got[60]["exact"] and not got[61]["exact"] and got[62]["words"] == 14
    left = decontaminate.clean(odd(spark, rows), bench)
    assert left.columns == odd(spark).columns and left.count() == len(rows) - 3
    assert decontaminate.contaminated(odd(spark, []), bench).count() == 0
    assert decontaminate.contaminated(odd(spark, rows), bench.where("item_id < 0")).count() == 0


def test_contamination_of_number_heavy_short_and_recased_items(spark):
    heavy = "Add 12 15 18 21 24 27 30 33 36 39 42 45 and then halve it"
    tom = "Tom has 5 apples. Tom buys 7 more apples. Tom eats 3 apples. How many apples does Tom have?"
    names = "Then Anna Bert Carl Dora Emil Fred Gina Hans Ida Jan Karl Lea met near the old mill on a day"
    bench = spark.createDataFrame([(1, heavy), (2, "What is 17 plus 25?"), (3, tom), (4, names)], "item_id long, text string")
    anna = tom.replace("Tom", "Anna").replace("5", "6").replace("7", "9")
    rows = [(1, "See: " + heavy), (2, "Quiz. what is 17 plus 25? Easy."), (3, "Now. " + anna), (4, names.lower()), (5, names.replace(" ", "\n")), (6, "what is 18 plus 25"), (7, None)]
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, False), (4, 4, True), (5, 4, True), (6, 2, False)}


def test_clean_goes_by_rows(spark):
    item = "a bench passage of many plain words that nobody would write twice by chance in other texts"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"x {item} y"), (None, "clean text without an id"), (5, f"{item} again"), (5, "a clean text that shares the id"), (5, "a clean text that shares the id"), (6, None), (None, None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _key string").repartition(2)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r[0] or 0, r[1] or "") for r in left.collect()) == sorted((d or 0, t or "") for d, t in rows if item not in (t or ""))


def template_copies(item, rng):
    """The item with other numbers and names, one to one; and with a conflict in the middle."""
    values = {w: str(rng.integers(100, 999)) for w in item.split() if w.isdigit()}
    return " ".join(values.get(w, w) for w in item.split())


def test_contamination_of_templates_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ad", "em", "il", "on", "ur", "ath", "esk")]
    items = [" ".join(str(rng.integers(10, 99)) if rng.random() < 0.2 else str(rng.choice(vocabulary)) for _ in range(rng.integers(15, 30))) for _ in range(40)]
    noise = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = []
    for i, item in enumerate(items):
        w = item.split()
        texts += [f"{noise(20)} {item} {noise(9)}", f"{noise(5)} {template_copies(item, rng)}", f"{noise(8)} {' '.join(w[:9])} {noise(8)}", noise(40)]
        w[len(w) // 2] = "12345" if w[len(w) // 2].isdigit() else "zzz"
        texts.append(" ".join(w))

    def brute(item, text):
        """Whether a run on some diagonal counts: all its 8-word windows whose words or templates (3 literals at
        least) agree, with values one to one in one of the readings; or a stretch of plain windows."""
        a, b = item.split(), text.split()
        t = lambda w: "#" if w.isdigit() else w
        fit = sum(sum(not x.isdigit() for x in a[i : i + 8]) >= 3 for i in range(len(a) - 7))
        for shift in range(-len(a) + 8, len(b) - 7):
            plain, form, pairs = [], [], {True: set(), False: set()}
            for i in range(max(0, -shift), min(len(a), len(b) - shift) - 7):
                x, y = a[i : i + 8], b[i + shift : i + shift + 8]
                slots = sum(w.isdigit() for w in x)
                if x == y:
                    plain.append(i)
                    pairs[True] |= {(v, v) for v in x if v.isdigit()}
                if slots and slots <= 5 and [*map(t, x)] == [*map(t, y)]:
                    form.append(i)
                    pairs[False] |= {(v, u) for v, u in zip(x, y) if v.isdigit()}
            whole = [i for i in plain if not any(w.isdigit() for w in a[i : i + 8])]
            agrees = lambda m: len(m) == len({v for v, _ in m}) == len({u for _, u in m})
            ways = [(set(plain) | set(form), pairs[True] | pairs[False]), (set(form) | set(whole), pairs[False])]
            got = next((w for w in ways if agrees(w[1])), None)
            if got is None:
                best = run = 0
                for k, i in enumerate(plain):
                    run = run + 1 if k and plain[k - 1] == i - 1 else 1
                    best = max(best, run)
                got = (range(best), set())
            n, m = len(got[0]), got[1]
            if not n:
                continue
            share = n / (len(a) - 7)
            if not all(v == u for v, u in m):
                share = max(share, min(1, min(n, len(set(form) | set(whole))) / max(fit, 1)))
            if n + 7 >= 13 or share >= 0.8:
                return True
        return False

    want = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if brute(item, text)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == want and {(5 * i + 1, i) for i in range(40)} <= want


# 5 mixing
def test_raking_meets_margins(spark, sf_dir):
    rows = raking.rake(docs_of(spark, sf_dir)).toPandas()
    total = rows.tokens.sum()
    for dim in ("source", "lang", "topic"):
        have = rows.groupby(dim).tokens.sum() ** 0.7
        want = have / have.sum()
        raked = (rows.weight * rows.tokens).groupby(rows[dim]).sum() / total
        assert (abs(raked - want) < 1e-3).all()
    assert abs((rows.probability * rows.tokens).sum() / total - 0.8) < 1e-6
    for dim in ("source", "lang", "topic"):  # the draw: at the target, or whole, and then the others share the rest
        own = rows.groupby(dim).tokens.sum() / total
        own = own[own > 0]
        take, goal = own * 0, own**0.7
        while abs(take.sum() - 0.8) > 1e-12:
            free = take < own
            rest = 0.8 - take[~free].sum()
            take[free] = np.minimum(own[free], rest * goal[free] / goal[free].sum())
        drawn = (rows.probability * rows.tokens).groupby(rows[dim]).sum() / total
        assert (abs(drawn[own.index] - take) < 2e-3).all(), (dim, drawn, take)
    assert abs(rows.sampled.mean() - rows.probability.mean()) < 0.05


def test_raking_of_many_cells_is_the_same(spark, sf_dir, monkeypatch):
    docs = docs_of(spark, sf_dir).where("doc_id % 3 = 0")
    rows = lambda: {r["doc_id"]: (round(r["weight"], 9), round(r["probability"], 9)) for r in raking.rake(docs, sweeps=3).collect()}
    few = rows()
    monkeypatch.setattr(raking, "FEW_CELLS", 0)
    monkeypatch.setattr(raking, "BLOCK", 1)
    assert rows() == few


def test_raking_odd_rows(spark):
    rows = raking.rake(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["probability"] <= 1 and r["weight"] >= 0 for r in rows)
    assert all(r["sampled"] for r in rows if r["tokens"] == 0)
    assert raking.rake(odd(spark, [])).count() == 0
    target = spark.createDataFrame([("en", 1.0)], "value string, share double")
    assert {r["lang"] for r in raking.rake(odd(spark), targets={"lang": target}).collect() if r["sampled"] and r["tokens"]} <= {"en"}
    assert raking.mixed(odd(spark)).columns == odd(spark).columns


# 6 near-duplicates
def brute_classes(texts, threshold=0.8):
    bags, owner = [], collections.defaultdict(list)
    for d, t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        bag = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter({t or "": 1})
        bags.append(bag)
    for n, bag in enumerate(bags):
        for s in bag:
            owner[s].append(n)
    up = list(range(len(bags)))
    find = lambda i: i if up[i] == i else find(up[i])
    for n, bag in enumerate(bags):
        for m in {m for s in bag for m in owner[s] if m < n}:
            low = sum((bag & bags[m]).values())
            if low / (sum(bag.values()) + sum(bags[m].values()) - low) >= threshold:
                a, b = find(n), find(m)
                up[max(a, b)] = min(a, b)
    least = {}
    for n, (d, _) in enumerate(texts):
        least[find(n)] = min(least.get(find(n), math.inf), d if d is not None else math.inf)
    return sorted((d, least[find(n)]) for n, (d, _) in enumerate(texts) if d is not None)


def test_near_duplicates_match_brute_force(spark, sf_dir, texts):
    rows = queries.op6_dartminhash_dedup(spark, sf_dir).collect()
    got = sorted((r["doc_id"], r["class_id"]) for r in rows)
    assert got == brute_classes(texts) and len({c for _, c in got}) < len(got)


def test_near_duplicates_of_hub_and_hot_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    hub = [word() for _ in range(200)]
    rows = [(1000, " ".join(hub))]
    for i in range(120):  # each near the hub, most not near each other
        w = list(hub)
        for at in rng.choice(200, 3, replace=False):
            w[at] = word()
        rows.append((i, " ".join(w)))
    passage = [word() for _ in range(60)]
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(20)])) for i in range(150)]  # about 0.6 alike
    rows += [(3000 + i, "one hot copy of a text that many share") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(dartminhash, "TILE", 64)
    got = sorted((r["doc_id"], r["class_id"]) for r in dartminhash.near_duplicates(docs).collect())
    assert got == brute_classes(rows)


def test_near_duplicates_odd_rows(spark):
    rows = dartminhash.near_duplicates(odd(spark)).collect()
    got = sorted((r["doc_id"], r["class_id"]) for r in rows if r["doc_id"] is not None)
    assert got == brute_classes([(r[0], r[1]) for r in ODD]) and len(rows) == len(ODD)
    kept = dartminhash.deduplicated(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-5, 1, 3, 6, 7, 8, 9]
    assert dartminhash.near_duplicates(odd(spark, [])).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.random(300) * 3, rng.random(300) * 3
    a[:100] = b[:100]
    owner = np.repeat([0, 1], 300)
    sig = dartminhash.signatures(owner, np.concatenate([elements, elements]), np.concatenate([a, b]), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    alone = dartminhash.signatures(np.zeros(300, int), elements, b, 1, 2048)
    assert (alone[0] == sig[1]).all()


# 7 personal data
def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    text, out = text or "", []
    out += [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.span()))
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    out.sort(key=lambda x: (x[1][0], disclosure.KINDS.index(x[0])))
    n = collections.Counter(k for k, _ in out)
    return (*(n[k] for k in disclosure.KINDS), ",".join(f"{k}:{a}:{b}" for k, (a, b) in out))


TRICKY = [
    "a@b.c_d@e.f x", "mail me: john.doe+x@mail.example.co.uk, or a.b@c", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.255 and 1.2.3 and 1.2.3.4.", "00000000000000000000000000000000000000000000000000001.2.3.4",
    "4111 1111 1111 1111, 4111-1111-1111-1111; 4111 1111 1111 1112 41111111111111111111111", "+1 (017) 555-7713 +44 20 7946 0958, +1.........2 + 1 234567890 +12345678901234567", "é€😀 +49 (30) 901820 é a@b.cc 10.0.0.1😀9807915762804490",
    "5 - 6 7--8 12 34", "x@y.z@q.r", "@@@ a@.b c@d. +", " ".join(str(i) + ".1.1.1" for i in range(300)) + " z@z.z", "_a@b.c-_d@e.f", "1" * 5000 + " " + "1 " * 4000, "+1" + "." * 3000 + " 4111111111111111",
]


def test_personal_data_base_matches_brute_force(spark, sf_dir, texts):
    rows = queries.op7_disclosure_spans(spark, sf_dir).collect()
    want = {d: brute_pii(t) for d, t in texts}
    for r in rows:
        *n, spans = want[r["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
    assert len(rows) == len(want) and sum(r["n_email"] for r in rows)


def test_personal_data_tricky_and_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [*ODD, *((100 + i, t, "en", "a", 1) for i, t in enumerate(TRICKY))]
    out = disclosure.personal_data(odd(spark, rows)).withColumn("base", disclosure.listed("base")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] not in (None, 2):
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base"]) == brute_pii(dict((x[0], x[1]) for x in rows)[r["doc_id"]]), r["doc_id"]
    assert disclosure.personal_data(odd(spark, [])).count() == 0
    red = spark.createDataFrame([("call a@b.cc now, é 1.2.3.4!",)], "text string").select(disclosure.redact(F.col("text"), F.expr("array(named_struct('start',5,'end',11,'kind','email'), named_struct('start',19,'end',26,'kind','ip'))")).alias("x"))
    assert red.first()["x"] == "call [email] now, é [ip]!"


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} about quirkville resident reach zoe@example.org soon thank you number {i}", "en", "a", 1) for i in range(6)]
    rows += [(50 + i, f"a resident said thank you soon about a note with number {i} reach", "en", "a", 1) for i in range(40)]
    rows += [(90, rows[0][1], "en", "a", 1), (91, "quirkville alone", "en", "a", 1)]
    got = {r["doc_id"]: r for r in disclosure.personal_data(odd(spark, rows)).collect()}
    text = rows[2][1]
    terms = {text[s["start"] : s["end"]] for s in got[2]["spans"] if s["kind"] == "term"}
    assert "resident" not in terms and "soon" not in terms and "quirkville" in terms
    assert not got[50]["spans"] and not got[91]["spans"]


def test_disclosing_terms_of_the_whole_text(spark):
    far = " ".join(["plain filler words"] * 20)
    rows = [(20 + i, f"Quirkville note {i} {far} zoe@example.org {far} again quirkville {i}", "en", "a", 1) for i in range(4)]
    rows += [(50 + i, f"note {i} {far} again", "en", "a", 1) for i in range(40)]
    got = {r["doc_id"]: r for r in disclosure.personal_data(odd(spark, rows)).collect()}
    for i, text, *_ in rows[:4]:
        assert [text[s["start"] : s["end"]] for s in got[i]["spans"] if s["kind"] == "term"] == ["Quirkville", "quirkville"]
    assert not got[50]["spans"]


def brute_disclosed(texts, alpha=0.9, support=3):
    """All spans of each text, by counting everything."""
    import regex

    email, secret = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*[0-9])(?=[0-9_]*[A-Za-z])[A-Za-z0-9_]{32,}"
    digits = lambda v: re.sub("[^0-9]", "", v)
    spans, ents, terms = {}, collections.defaultdict(set), {}
    for t in set(texts):
        own = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_pii(t)[-1].split(",") if x)]
        own += [("secret", *m.span()) for m in re.finditer(secret, t)]
        spans[t] = own
        for k, a, b in own:
            v = t[a:b]
            value = digits(v) if k in ("card", "phone") else v.lower()
            group = {"email": v.rpartition("@")[2].lower(), "ip": v.rpartition(".")[0], "card": digits(v)[:6], "phone": digits(v)[:-7], "secret": None}[k]
            for e in [("value", k, value), ("kind", k)] + ([("group", k, group)] if group is not None else []):
                ents[e].add(t)
        masked = re.sub(f"{email}|{secret}", lambda m: " " * len(m[0]), t)
        terms[t] = [(m.span(), m[0].lower()) for m in regex.finditer(r"\p{L}{4,}", masked)]
    n, n_t, meet = len(spans), collections.Counter(), collections.Counter()
    for t in spans:
        n_t.update({m[0].lower() for m in regex.finditer(r"\p{L}{4,}", t)})
    for e, own in ents.items():
        meet.update((e, w) for t in own for w in {w for _, w in terms[t]})
    good = collections.defaultdict(set)
    for (e, w), n_et in meet.items():
        n_e = len(ents[e])
        content = math.log(n / n_e)
        if n_et >= support and content > 0 and n_et * content >= 2 * math.log(n) and math.log(n_et * n / (n_e * n_t[w])) >= alpha * content - 1e-9:
            good[e].add(w)
    order = [*disclosure.KINDS, *disclosure.ADDED]
    return {t: sorted(spans[t] + [("term", *at) for at, w in terms[t] if any(w in good[e] and t in ents[e] for e in ents)], key=lambda s: (s[1], order.index(s[0]))) for t in spans}


def test_disclosure_matches_brute_force(spark, sf_dir, texts):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("bolt", "carm", "dune", "fern") for b in ("ish", "ado", "ent", "ora", "ulp", "\u0130stan", "ümel")]
    made = []
    for i in range(120):
        w = list(rng.choice(words, 6))
        if i % 6 == 0:
            w += ["Writeto", f"user{i}@corp{i % 12}.example.com"]
        if i % 10 == 0:
            w += ["secretly", "%040x" % (7919**9 + i)]
        if i % 8 == 0:
            w += [f"10.1.{i % 16}.{i}", "hostname", "\u0130\u0130\u0130 zorb"]
        made.append(" ".join(w))
    made += [made[0], "\u0130\u0130\u0130\u0130 zorbanite a0 joe@corp.example", "no data Writeto hostname"]
    for group in (made, [t for _, t in texts]):
        docs = spark.createDataFrame(list(enumerate(group)), "doc_id long, text string").repartition(3)
        want = brute_disclosed(group)
        for r in disclosure.personal_data(docs).collect():
            assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == want[group[r["doc_id"]]], group[r["doc_id"]]
            assert r["n_spans"] == len(r["spans"])
        assert any(s[0] == "term" for x in want.values() for s in x)
    assert not want[next(t for _, t in texts if not want[t])]


# memory of workers, which idle beside the JVM of their executor
def test_workers_keep_little_between_stages(spark, monkeypatch):
    from quirewise.llm import common

    assert common._POW.nbytes + common._INV.nbytes <= 8 << 20
    seen, df = [], spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: seen.append((self, f)) or plain(self, f, *a, **b))
    rows = sstable.token_shards(df)
    files, read = seen[-1]
    monkeypatch.setitem(sstable._ENCODERS, "a file", object())
    assert sum(b.num_rows for b in read(iter(files.toArrow().to_batches()))) == rows.count() == 40
    assert not sstable._ENCODERS


def test_words_around_the_block_size():
    from quirewise.llm import common

    block = common._BLOCK
    words = ["a", "B" * (block - 1), "c" * block, "d" * (block + 1), "e" * (5 * block), "x y", "f" * 70]
    text = " ".join([*words, "z" * 13, *words]).encode()
    data = np.frombuffer(text, np.uint8)
    start, end, _, h = common.words_of(data, np.array([0, len(text)]))
    names = [text[a:b].lower() for a, b in zip(start, end)]
    assert names == text.lower().split() and len(set(zip(names, h.tolist()))) == len(set(names)) == len(set(h.tolist()))


# 8 nearest neighbours
def test_nearest_recall_and_scores(spark, sf_dir, duck):
    rows = queries.op8_pruned_graph_search(spark, sf_dir).collect()
    data = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([d[0] for d in data]), np.array([d[1] for d in data], np.float32).astype(np.float64)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits += len(set(best) & {i for i, _ in got[q]})
        assert len(got[q]) == 10 and all(abs(s - d[ids == i][0]) < 1e-12 for i, s in got[q])
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q])
    assert hits >= 0.9 * 10 * len(got)


def test_nearest_larger_shards_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 64)).astype(np.float32)
    graph, entry = vamana.build_graph(x)
    q = x[::100]
    ids, _ = vamana.beam_search(x, graph, entry, q, 64)
    d = ((x[None] - q[:, None]) ** 2).sum(-1)
    want = np.argsort(d, 1)[:, :11]
    assert np.mean([len(set(a) & set(b[:11])) / 11 for a, b in zip(want, ids)]) >= 0.9


def test_nearest_recall_in_tight_clusters(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=64)
    x = middle / np.linalg.norm(middle) * (1 + 3e-4 * rng.normal(size=(1500, 64)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in vamana.nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = [len(got[q] & set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist())) for q in range(0, 1500, 100)]
    assert np.mean(hits) >= 9


def test_nearest_copies_ties_and_odd_rows(spark):
    one = [1.0, 0.0]
    rows = [(i, one) for i in range(0, 400)] + [(1000, [2.0, 0.0]), (1100, None), (1200, [0.0, 0.0]), (1300, [float("nan"), 1.0]), (1400, [None, 1.0]), (1500, [float("inf"), 1.0]), (1600, []), (None, [1.0, 2.0]), (1000, [2.0, 0.0]), (1700, [1.0, 1.0, 1.0])]
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for r in sorted(vamana.nearest(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300, 1000}
    assert got[0] == [(i, i, 0.0) for i in range(1, 11)] and got[100] == [(i + 1, i, 0.0) for i in range(10)]
    assert got[1000] == [(i + 1, i, 1.0) for i in range(10)]
    assert vamana.nearest(df.where("vec_id < 0")).count() == 0
    few = vamana.nearest(df.where("vec_id in (100, 1000)")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(100, 1000), (1000, 100)]


def test_nearest_search_holds_little_and_sends_only_the_nearest(spark, monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: seen.append((self, f)) or plain(self, f, *a, **b))
    out = vamana.nearest(df, df, k=5, shard=300).collect()
    work, search = seen[-1]
    batches = work.toArrow().to_batches()
    assert sum(b.num_rows for b in batches) > 1  # shards
    tracemalloc.start()
    sent = pa.Table.from_batches(list(search(iter(batches)))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sent) == len(out) == 5 * len(x) and {tuple(r.values()) for r in sent} == {(r["query_id"], r["vec_id"], r["score"]) for r in out}
    assert peak < 100 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


# 9 urls
def brute_url(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in queries.URL_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "block" if url in listed else "allow"


def test_url_filter_matches_brute_force(spark, sf_dir, duck):
    rows = queries.op9_bloom_url_filter(spark, sf_dir).collect()
    pages = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    spam = {u for u in pages.values() if set(u.split("://")[1].split("/")[0].lower().split(".")) & set(queries.LISTED_LABELS)}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got == {p: brute_url(u, spam) for p, u in pages.items()} and len(rows) == len(pages)
    assert spam and any(rule is None and verdict == "block" for _, _, rule, verdict in got.values())


def test_url_filter_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://com/", "http://com", "http://acom/", "ftp://x.net/es/1", "http://x.net/es", "http://x.net/ES/1", "http://a.org/x/?utm_source=1&b=2#t", "https://www.a.org/x?b=2", "http://a.org?x=://y/", "http://u:p@h.com:80/z", "a://b://c.com/d"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(4, urls[4], "clash"), (None, "http://com/", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([("a.org/x?b=2",), (None,), ("",)], "canonical string")
    out = urlfilter.filter_urls(df, queries.URL_RULES, listed).collect()
    assert len(out) == len(rows)
    blocked = {urls[11], urls[12]}
    for r in out:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(urls[r["page_id"]], blocked), urls[r["page_id"]]
    assert urlfilter.filter_urls(df.where("page_id < 0"), queries.URL_RULES, listed).count() == 0
    assert urlfilter.filter_urls(df, [], None).where("verdict = 'block' or rule is not null").count() == 0


def test_salted_url_join(spark, sf_dir, monkeypatch):
    plain = queries.op9_bloom_url_filter(spark, sf_dir).collect()
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", 0)
    assert sorted(map(str, queries.op9_bloom_url_filter(spark, sf_dir).collect())) == sorted(map(str, plain))


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) as key")
    blocks = urlfilter.build_filter(keys)
    h = np.array([r[0] for r in spark.range(20000).selectExpr("xxhash64(cast(id as string))").collect()], np.int64)
    ok = urlfilter.probe(blocks, h)
    assert ok[:5000].all() and ok[5000:].mean() < 0.02


# 10 token shards
def test_token_shards_round_trip(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(sstable.tokenizer_path("byte_bpe_50k.json"))
    start, want = 0, {}
    for d, text in sorted(texts):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = queries.op10_token_shards(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def test_token_shards_odd_rows_and_lookup(spark, tmp_path):
    docs = odd(spark, [*ODD, (70, "two  spaces   three \n \n  a\u00a0 b <|endoftext|> it's x ", "en", "a", 1), (71, "a  ", "en", "a", 1)])
    folder = f"file://{tmp_path}/sst"
    manifest = sstable.write_shards(docs, folder, "byte_bpe_50k.json", shard_bytes=2000)
    rows = sstable.read_shards(spark, folder, manifest).collect()
    whole = sstable.Encoder(sstable.tokenizer_path("byte_bpe_50k.json"))
    assert len(rows) == len(ODD) + 2 and len(manifest) > 1
    by = {(d, t) for d, t, *_ in [*ODD, (70, "two  spaces   three \n \n  a\u00a0 b <|endoftext|> it's x ", 0), (71, "a  ", 0)]}
    want = sorted((d is not None, d or 0, zlib.crc32(np.array(whole.tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in by)
    assert sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in rows}) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    found = []
    for m in manifest:
        with open(m["path"], "rb") as f:
            found += sstable.Reader(f).get(70)
    assert len(found) == 1 and found[0][-1] == 2
    assert sstable.token_shards(odd(spark, [])).count() == 0


def test_added_tokens_as_the_library_encodes_them():
    from tokenizers import Tokenizer

    path = sstable.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["end<|endoftext|>start", "a <|endoftext|> b\nc", "<|endoftext|>", "no token <|endoftext >", "plain words"]
    got = [np.frombuffer(x, "<u4").tolist() for x in sstable.Encoder(path).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [437, 50256, 9688]


def test_ids_wider_than_their_bytes_are_refused(spark, tmp_path):
    path = sstable.tokenizer_path("byte_bpe_50k.json")
    assert sstable.width_for(path, 2) == 2 and sstable.width_for(path, 70_000) == 4
    with pytest.raises(ValueError):
        sstable.width_for(path, 70_000, 2)
    docs = spark.createDataFrame([(7, "one"), (7, "two"), (7, "three"), (7, "two")], "doc_id long, text string")
    orders = [[(r["ids_crc32"], r["start"]) for r in sstable.token_shards(docs.repartition(n), end_id=70_000, folder=f"file://{tmp_path}/{n}").orderBy("start").collect()] for n in (1, 3)]
    assert orders[0] == orders[1]


def test_shard_file_search():
    sink = io.BytesIO()
    sink.close_ = sink.close
    keep = {}

    class Sink(io.BytesIO):
        def close(self):
            keep["data"] = self.getvalue()

    w = sstable.Writer(Sink())
    for i in range(-500, 1000, 3):
        w.add(sstable.key_of(i), np.arange(abs(i) % 7))
    w.close()
    r = sstable.Reader(io.BytesIO(keep["data"]))
    assert len(r.index) > 5 and r.entries == 500
    assert all(len(r.get(i)) == ((i + 500) % 3 == 0 and -500 <= i < 1000) for i in range(-510, 1010))
    assert [sstable.id_of(k) for k, _ in r] == list(range(-500, 1000, 3))
    with pytest.raises(ValueError):
        bad = sstable.Writer(io.BytesIO())
        bad.add(sstable.key_of(2), np.arange(1))
        bad.add(sstable.key_of(1), np.arange(1))


def test_oracles(spark, sf_dir, duck):
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf_dir).toPandas()
        want = duck.execute(sql).df()[list(got.columns)]
        a, b = (sorted(tuple(None if v is None or v != v else v for v in r) for r in x.itertuples(index=False)) if name != "op9_bloom_url_filter" else sorted(tuple(str(v) if v is not None and v == v else "" for v in r) for r in x.itertuples(index=False)) for x in (got, want))
        assert a == b, name


# pipeline
def test_pipeline(spark, sf_dir, texts, duck):
    import corpus_pipeline

    docs = docs_of(spark, sf_dir)
    names, kept = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, sf_dir), name)
        assert kept.columns == names
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and len(set(counts)) == 5
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    good = {d for (d,) in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    accepted = {r["doc_id"] for r in corpus_pipeline.quality_filter(spark, docs, sf_dir).select("doc_id").collect()}
    assert len(good & accepted) >= 0.98 * len(good)


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline

    for rows in (ODD, []):
        docs = odd(spark, rows)
        names, before = docs.columns, len(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
            assert docs.columns == names and docs.count() <= before, name
            before = docs.count()
        assert corpus_pipeline.token_output(spark, docs, sf_dir).count() == before


def test_scratch_space_must_be_shared():
    from types import SimpleNamespace

    from quirewise.llm.common import scratch_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert scratch_dir(session("yarn", "hdfs:///x/"), "a").startswith("hdfs:///x/quirewise-a-")
    assert scratch_dir(session("local[2]", None), "a").startswith("file:///")
    with pytest.raises(ValueError):
        scratch_dir(session("spark://host:7077", None), "a")
