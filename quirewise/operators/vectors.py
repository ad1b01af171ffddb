"""Classification by nearest reference vectors, and entities from token scores.

Models are providers: a function from a batch of texts to unit vectors (or token scores). It is called by
an Arrow function over batches of all documents' texts, once loaded a worker; nothing else here needs one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

#: References are a fixed table of a few hundred rows; a larger one is joined without a broadcast hint.
REFERENCE_ROWS = 2000
#: References of one block beyond that.
REFERENCE_BLOCK = 500


def encode(df: DataFrame, text: str, provider: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "vector") -> DataFrame:
    """Adds the provider's unit vector of a text column; the model loads once a worker and sees whole batches."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider()
        for texts in batches:
            yield pd.Series(list(model([t or "" for t in texts])))

    return df.withColumn(name, run(F.col(text)))


def hashed_provider(dim: int = 32):
    """A stand-in for a model in tests: character trigrams hashed to a unit vector."""

    def load():
        import math
        import zlib

        def model(texts):
            out = []
            for t in texts:
                v = [0.0] * dim
                s = f"  {t.lower()} "
                for i in range(len(s) - 2):
                    v[zlib.crc32(s[i : i + 3].encode()) % dim] += 1.0
                n = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / n for x in v])
            return out

        return model

    return load


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _near(refs: DataFrame) -> DataFrame:
    return F.broadcast(refs) if refs.count() <= REFERENCE_ROWS else refs


def class_scores(candidates: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, score, ord): each candidate's best score a class.

    Every candidate meets every reference by definition. A counted few references ride along as one broadcast
    array, so it is a map over candidates; more are packed into blocks of REFERENCE_BLOCK rows, candidates are
    dealt to every block, and the best of the blocks counts."""
    count = refs.count()
    blocks = 1 if count <= REFERENCE_ROWS else -(-count // REFERENCE_BLOCK)
    numbered = refs.select("class", "ord", "vector", F.pmod(F.xxhash64("class", "ord"), F.lit(blocks)).alias("_block"))
    packed = numbered.groupBy("_block", "class").agg(F.min("ord").alias("ord"), F.collect_list("vector").alias("vectors")).groupBy("_block").agg(F.collect_list(F.struct("class", "ord", "vectors")).alias("refs"))
    each = candidates.select(*keys, F.col("vector"))
    if blocks == 1:
        each = each.join(F.broadcast(packed.select("refs")))
    else:
        each = each.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "_block")
    best = F.transform("refs", lambda r: F.struct(r["class"].alias("class"), r["ord"].alias("ord"), F.array_max(F.transform(r["vectors"], lambda v: dot(F.col("vector"), v))).alias("score")))
    scored = each.select(*keys, F.explode(best).alias("b")).select(*keys, "b.class", "b.ord", "b.score")
    return scored if blocks == 1 else scored.groupBy(*keys, "class").agg(F.min("ord").alias("ord"), F.max("score").alias("score"))


def winners(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, score, runner_up); of equal scores the earlier reference wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "ord")
    ranked = scores.withColumn("r", F.row_number().over(w)).withColumn("runner_up", F.lead("score").over(w))
    return ranked.where("r = 1").select(*keys, "class", "score", "runner_up")


def classify(candidates: DataFrame, refs: DataFrame, keys: list[str], similarity: float, margin: float) -> DataFrame:
    """The winners at or above ``similarity`` with ``margin`` over the runner-up (if there is one)."""
    return winners(class_scores(candidates, refs, keys), keys).where((F.col("score") >= similarity) & (F.col("score") - F.coalesce("runner_up", F.lit(-1.0)) >= margin))


def exact_class(texts: DataFrame, refs: DataFrame, text: str) -> DataFrame:
    """Adds class, of the first reference whose phrase equals the text (case and spacing aside); null if none."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    first = refs.groupBy(fold(F.col("phrase")).alias("_k")).agg(F.min_by("class", "ord").alias("class"))
    return texts.withColumn("_k", fold(F.col(text))).join(_near(first), "_k", "left").drop("_k")


def attribute_labels(labels: DataFrame, refs: DataFrame, key: str, provider) -> DataFrame:
    """(key, class, confidence): an exact label has confidence 1, others go to the model."""
    known = exact_class(labels, refs, "label")
    exact = known.where("class is not null").select(key, "class", F.lit(1.0).alias("confidence"))
    rest = encode(known.where("class is null").drop("class"), "label", provider)
    vectors = encode(refs, "phrase", provider)
    found = classify(rest, vectors, [key], P.ATTRIBUTE_SIMILARITY, P.ATTRIBUTE_MARGIN).select(key, "class", F.col("score").alias("confidence"))
    return exact.unionByName(found)


def title_scores(candidates: DataFrame, positive: DataFrame, negative: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence, against, accepted): best job title against best text that is none."""
    yes = class_scores(candidates, positive, keys).groupBy(*keys).agg(F.max("score").alias("confidence"))
    no = class_scores(candidates, negative, keys).groupBy(*keys).agg(F.max("score").alias("against"))
    return yes.join(no, keys).withColumn("accepted", (F.col("confidence") >= P.TITLE_SIMILARITY) & (F.col("confidence") - F.col("against") >= P.TITLE_MARGIN))


def title_segments(text: Column) -> Column:
    """The first three segments of a header line that may be titles: up to ten words, a letter, no digit or @."""
    parts = F.transform(F.split(text, P.TITLE_SEPARATOR), lambda s: F.btrim(s, F.lit(" \t,;:-" + P.INVISIBLE)))
    fine = F.filter(parts, lambda s: (s != "") & s.rlike(r"\p{L}") & (F.size(F.split(s, r"(?U)\s+")) <= P.TITLE_WORDS))
    return F.slice(fine, 1, P.TITLE_SEGMENTS)


def phrase_titles(lines: DataFrame, phrases: list[str]) -> DataFrame:
    """Lines' literal job titles, longest first, at word bounds."""
    import re

    from ..functions.spans import find_all

    pattern = r"(?iuU)\b(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"
    return lines.select("doc_id", "line_index", F.explode(find_all(F.col("text"), pattern)).alias("m")).select("doc_id", "line_index", "m.start", "m.end", "m.text")


def argmax_tags(tokens: DataFrame) -> DataFrame:
    """Adds tag_no and score (softmax, the stable way) to tokens with logits."""
    top = F.array_max("logits")
    total = F.aggregate(F.col("logits"), F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return tokens.withColumn("score", 1 / total).withColumn("tag_no", F.array_position("logits", top) - 1)


def entity_groups(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, start, end, score): runs of neighbouring tokens of one label; B- opens a run, I- and a bare
    label go on; O ends it. The score is the mean of its tokens'."""
    label = F.regexp_replace("tag", "^[BI]-", "")
    w = Window.partitionBy(*keys).orderBy("tok_no")
    t = tokens.withColumn("label", F.when(F.col("tag") != "O", label))
    opens = F.col("label").isNull() | F.col("tag").startswith("B-") | F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True))
    run = t.withColumn("run", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("label is not null").groupBy(*keys, "run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score")).drop("run")


def merged_entities(entities: DataFrame, texts: DataFrame, keys: list[str], threshold: float = P.NER_CONFIDENCE) -> DataFrame:
    """Entities at or above the threshold; neighbours of one label with at most three characters between, none a
    letter or digit, are one, with the lower score."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    e = entities.where(F.col("score") >= threshold).join(texts, keys)
    gap = F.col("start") - F.lag("end").over(w)
    between = F.substring(F.col("text"), F.lag("end").over(w) + 1, F.greatest(gap, F.lit(0)))
    joins = (F.lag("label").over(w) == F.col("label")) & (gap <= 3) & ~between.rlike(r"[\p{L}\p{N}]")
    run = e.withColumn("run", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*keys, "run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score"), F.first("text").alias("_t"))
    return out.select(*keys, "label", "start", "end", "score", F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
