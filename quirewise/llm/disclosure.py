"""Personal data: pattern spans, then information-theoretic sanitisation of what reveals them.

DataFrame operations only. Protected entities are what the patterns find, at three levels: the value, what it
is part of (an email's domain, an address's network, a card's issuer, a phone's area) and its kind; strings of
32 and more letters and digits are protected as ``secret``. Corpus co-occurrence says how far a term discloses
an entity: with p the share of distinct texts, the term's pointwise mutual information with the entity,
log p(e,t)/(p(e)p(t)), is set against the entity's information content, -log p(e). Terms at or above ``alpha``
of it (1: seeing the term gives the entity away) become spans of kind ``term`` in the texts that hold the
entity, if at least ``support`` distinct texts show both and that many meetings are no chance: p(e) to their
number is at most 1/N^2 for N texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
ADDED = ("secret", "term")
#: Leftmost non-overlapping matches of the plain patterns, made linear: a run is entered at its first
#: character (or where the last match ended) and never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{32,}+",
}
#: What a text must hold for a kind's pattern to be tried at all.
GATES = {"email": "instr(_t, '@') > 0", "ip": r"_t RLIKE r'[0-9][.][0-9]'", "card": r"_t RLIKE r'[0-9](?:[ -]?[0-9]){13}'", "phone": r"instr(_t, '+') > 0 AND _t RLIKE r'[+][0-9]'", "secret": "_t RLIKE r'[A-Za-z0-9_]{32}'"}
VALID = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": "length(translate(x.value, ' -', '')) BETWEEN 14 AND 19 AND luhn_check(translate(x.value, ' -', ''))",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 10 AND 15",
    "secret": "true",
}
_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
#: What stands for a value, and what it is part of (null: nothing).
VALUE = f"CASE WHEN s.kind IN ('card', 'phone') THEN {_DIGITS} ELSE lower(s.value) END"
GROUP = f"CASE s.kind WHEN 'email' THEN lower(substring_index(s.value, '@', -1)) WHEN 'ip' THEN substring_index(s.value, '.', 3) WHEN 'card' THEN left({_DIGITS}, 6) WHEN 'phone' THEN left({_DIGITS}, length({_DIGITS}) - 7) END"
ENTITIES = f"array_distinct(flatten(transform(spans, s -> array_compact(array(xxhash64('value', s.kind, {VALUE}), CASE WHEN s.kind <> 'secret' THEN xxhash64('group', s.kind, {GROUP}) END, xxhash64('kind', s.kind))))))"
TERM = r"\p{L}{4,}"
BROADCAST_ROWS = 1_000_000
#: One in so many texts without identifiers is counted beforehand: a bound that rules out common words.
AHEAD = 16
_B = 64


def located(text: Column, pattern: str, gate: Column | None = None) -> list[tuple[str, Column]]:
    """Column definitions, in order, that end in ``_found``: array<struct<start, end, value>> of all matches,
    in code points. Starts are sums of the lengths before, kept in blocks so that cost stays near linear."""
    gate = F.lit(True) if gate is None else gate
    steps = f"""transform(_pieces, (x, j) -> length(x) + CASE WHEN j > 0 THEN length(_values[j - 1]) ELSE 0 END)"""
    blocks = f"""aggregate(sequence(0, size(_values) div {_B}), array(0), (acc, b) -> array_append(acc, element_at(acc, -1) + aggregate(slice(_steps, b * {_B} + 1, {_B}), 0, (s, v) -> s + v)))"""
    found = f"""transform(sequence(0, size(_values) - 1), i -> named_struct('start', _blocks[i div {_B}] + aggregate(slice(_steps, (i div {_B}) * {_B} + 1, i % {_B} + 1), 0, (s, v) -> s + v), 'value', _values[i]))"""
    some = "size(_values) > 0"
    return [
        ("_values", F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))),
        ("_pieces", F.when(F.expr(some), F.split(text, pattern, -1))),
        ("_steps", F.expr(f"CASE WHEN {some} THEN {steps} END")),
        ("_blocks", F.expr(f"CASE WHEN {some} THEN {blocks} END")),
        ("_found", F.expr(f"CASE WHEN {some} THEN transform({found}, x -> named_struct('start', x.start, 'end', x.start + length(x.value), 'value', x.value)) ELSE cast(array() as array<struct<start:int,end:int,value:string>>) END")),
    ]


def _masked(text: Column) -> Column:
    """The text with what identifiers have of letters blanked, code point for code point."""
    cut = F.lit(f"{PATTERNS['email']}|{PATTERNS['secret']}")
    found = F.regexp_extract_all(text, cut, F.lit(0))
    blanks = F.concat(F.transform(found, lambda v: F.repeat(F.lit(" "), F.length(v))), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, f"{PATTERNS['email']}|{PATTERNS['secret']}", -1), blanks, lambda a, b: F.concat(a, b)), "")


def _hash(value: Column) -> Column:
    return F.xxhash64(F.lower(value))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, spans, _t, _terms) with spans: array<struct<start, kind_no, end, kind, value>>, sorted; _key
    names the text; rows with spans keep the text and the hashes of its terms."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    kinds = (*KINDS, ADDED[0])
    for n, kind in enumerate(kinds):
        for name, column in located(F.col("_t"), PATTERNS[kind], F.expr(GATES[kind])):
            rows = rows.withColumn(name, column)
        rows = rows.withColumn(f"_{kind}", F.expr(f"transform(filter(_found, x -> {VALID[kind]}), x -> named_struct('start', x.start, 'kind_no', {n}, 'end', x.end, 'kind', '{kind}', 'value', x.value))")).drop("_values", "_pieces", "_steps", "_blocks", "_found")
    spans = f"array_sort(concat({', '.join('_' + k for k in kinds)}))"
    rows = rows.withColumn("spans", F.expr(spans)).withColumn("_key", F.xxhash64("_t"))
    some = F.size("spans") > 0
    terms = F.array_distinct(F.transform(F.regexp_extract_all(_masked(F.col("_t")), F.lit(TERM), F.lit(0)), _hash))
    return rows.select("doc_id", "_key", "spans", F.when(some, F.col("_t")).alias("_t"), F.when(some, terms).alias("_terms"))


def _content(texts: int) -> Column:
    return -F.log(F.col("n_e") / F.lit(float(max(texts, 1))))


def _reveals(texts: int, alpha: float) -> Column:
    """Over n_et, n_e, n_t: whether the term's information about the entity is alpha of the entity's own."""
    content = _content(texts)
    return (content > 0) & (F.log(F.col("n_et") * F.lit(float(max(texts, 1))) / (F.col("n_e") * F.col("n_t"))) >= alpha * content - 1e-9)


def _few(table: DataFrame, tag: str) -> DataFrame:
    """Written out, and broadcast where its counted rows are few."""
    table = materialize(table, tag)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _disclosing(docs: DataFrame, held: DataFrame, texts: int, alpha: float, support: int) -> DataFrame:
    """(_e, term): hashes of the terms that disclose an entity, from held texts (_key, _ents, _terms)."""
    n_e = held.select(F.explode("_ents").alias("_e")).groupBy("_e").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    known = _few(n_e, "entities")
    # rare entities go first: most values are in one text only
    pairs = held.select("_key", "_terms", F.explode("_ents").alias("_e")).join(known, "_e").select("_e", "n_e", F.explode("_terms").alias("term"))
    together = pairs.groupBy("_e", "term").agg(F.first("n_e").alias("n_e"), F.count("*").alias("n_et"))
    together = materialize(together.where((F.col("n_et") >= support) & (F.col("n_et") * _content(texts) >= 2 * F.log(F.lit(float(max(texts, 2)))))), "together")
    if together.isEmpty():
        return together.select("_e", "term")
    # any part of the corpus bounds a term's texts from below, which rules out all common words
    whole = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_t")).where("_t != ''").select(F.xxhash64("_t").alias("_key"), "_t")
    words = F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(TERM), F.lit(0)), _hash))
    some = together.select("term").distinct()
    ahead = whole.where(F.pmod("_key", F.lit(AHEAD)) == 0).select("_key", F.explode(words).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_a"))
    least = held.select("_key", F.explode("_terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    bound = some.join(least, "term").join(ahead, "term", "left").select("term", F.greatest("n_t", F.coalesce("n_a", F.lit(0))).alias("n_t"))
    together = materialize(together.join(bound, "term").where(_reveals(texts, alpha)).drop("n_t"), "together")
    terms = _few(together.select("term").distinct(), "candidates")
    seen = whole.select("_key", F.explode(words).alias("term")).join(terms, "term", "left_semi").distinct()
    n_t = seen.groupBy("term").agg(F.count("*").alias("n_t"))
    return together.join(n_t, "term").where(_reveals(texts, alpha)).select("_e", "term")


def personal_data(docs: DataFrame, alpha: float = 0.9, support: int = 3) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, n_spans, base, spans), one for each row of docs.

    ``base`` and ``spans`` are arrays of (start, end, kind) in code points, end exclusive, by start and then
    kind as listed (secret, term last); ``spans`` adds secrets and disclosing terms. Terms are runs of four or
    more letters, case aside, in what emails and secrets leave of a text, at every place. An entity in fewer
    than ``support`` distinct texts has none. Null texts count as empty: no spans. Repeated rows stay and add
    nothing to the counts, which are over distinct texts; an empty table gives no rows; other columns are
    ignored.
    """
    found = materialize(base_spans(docs), "spans")
    texts = found.select("_key").distinct().count()
    held = materialize(found.where("_t is not null").dropDuplicates(["_key"]).select("_key", F.expr(ENTITIES).alias("_ents"), "_terms"), "held")
    reveals = materialize(_disclosing(docs, held, texts, alpha, support), "reveals")
    # a term's entities share its texts, so they are few
    by_term = _few(reveals.groupBy("term").agg(F.collect_set("_e").alias("_es")), "terms")
    marked = held.select("_key", "_ents", F.explode("_terms").alias("term")).join(by_term, "term").where(F.arrays_overlap("_ents", "_es"))
    marked = _few(marked.groupBy("_key").agg(F.collect_set("term").alias("_marks")), "marked")  # bounded by one text
    # rows without spans have nothing to be joined
    out = found.where("_t is not null").join(marked, "_key", "left").withColumn("_t", F.when(F.col("_marks").isNotNull(), F.col("_t")))
    out = out.withColumn("_m", _masked(F.col("_t")))
    for name, column in located(F.col("_m"), TERM, F.col("_m").isNotNull()):
        out = out.withColumn(name, column)
    kinds = len(KINDS)
    out = out.withColumn("_marked", F.expr(f"transform(filter(_found, x -> array_contains(_marks, xxhash64(lower(x.value)))), x -> named_struct('start', x.start, 'kind_no', {kinds + 1}, 'end', x.end, 'kind', '{ADDED[1]}'))"))
    # written, as what follows reads the places several times over
    out = materialize(out.select("doc_id", "spans", "_marked"), "places").unionByName(found.where("_t is null").select("doc_id", "spans"), allowMissingColumns=True)
    plain = "transform({}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))"
    out = out.withColumn("_all", F.expr("transform(spans, s -> named_struct('start', s.start, 'kind_no', s.kind_no, 'end', s.end, 'kind', s.kind))"))
    out = out.withColumn("_all", F.expr("CASE WHEN size(_marked) > 0 THEN array_sort(concat(_all, _marked)) ELSE _all END"))
    return out.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS], F.size("_all").cast("long").alias("n_spans"),
        F.expr(plain.format(f"filter(spans, s -> s.kind_no < {kinds})")).alias("base"),
        F.expr(plain.format("_all")).alias("spans"),
    )


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with its (start, end, kind) spans generalised to [kind]; of overlapping ones the first holds."""
    return F.concat(
        F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].cast("int").alias("at"))).otherwise(a), lambda a: a["out"]),
        F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"].cast("int")), lambda a: F.substring(text, a + 1, F.length(text))),
    )
