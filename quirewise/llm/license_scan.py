"""Fuzzy search for short license notices.

Each notice is cut into one more piece than the edits it allows, so any copy within that many edits holds
one piece unchanged (pigeonhole). An Aho-Corasick automaton finds the pieces in the normalised words of
whole texts, and the regex library's bounded-error matching checks the place and gives the span.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Exact phrases of the base labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Words that tell one license from another: no edit may fall on them (numbers never take any). Of a version
#: like "2 0" the first number tells.
EXACT = frozenset("mit apache gnu lesser affero mozilla nc sa cc by reserved".split())
#: Notices searched with errors: (words, label).
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SPANS = "array<struct<label:string,first:bigint,words:int,edits:int,score:double,text:string>>"


def allowed(phrase: str, share: float) -> int:
    return int(len(phrase) * share)


def telling(phrase: str) -> list[bytes]:
    """The notice's words that must stand in a place as they are, in order."""
    words = phrase.split()
    return [w.encode() for i, w in enumerate(words) if w in EXACT or w.isdigit() and not (i and words[i - 1].isdigit())]


def holds(words: list[bytes], wanted: list[bytes]) -> bool:
    """Whether ``wanted`` stand among ``words`` in order."""
    rest = iter(words)
    return all(w in rest for w in wanted)


class Scanner:
    """Search state of one worker."""

    def __init__(self, notices=NOTICES, base=BASE, share: float = 0.1):
        import ahocorasick
        import regex

        self.base = [(f" {p} ".encode(), label) for p, label in base]
        self.notices, seeds = [], {}
        for n, (phrase, label) in enumerate(notices):
            k = allowed(phrase, share)
            self.notices.append((phrase, label, k, telling(phrase), regex.compile(rf"(?b)(?:{regex.escape(phrase)}){{e<={k}}}")))
            edge = [round(i * len(phrase) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(edge, edge[1:]):
                seeds.setdefault(phrase[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def scan(self, text: str):
        """(words, [first word of each base place], base labels, fuzzy spans) of a whole text."""
        words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
        norm = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in self.base:
            at = norm.find(phrase)
            while at >= 0:
                places.append(norm.count(b" ", 0, at))  # separators before it: words before it
                labels.add(label)
                at = norm.find(phrase, at + 1)
        flat = norm.decode("latin-1")  # a character a byte
        tried, spans = {}, {}
        for end, (size, uses) in self.seeds.iter(flat):
            for n, offset in uses:
                start = end + 1 - size - offset
                phrase, label, k, wanted, pattern = self.notices[n]
                if tried.get(n) == start:  # another piece of the same place
                    continue
                tried[n] = start
                lo = max(0, start - k)
                hit = pattern.search(flat, lo, min(len(flat), start + len(phrase) + k + 1))
                if hit:
                    # whole words only: a span starts after and ends before a separator
                    a, b = hit.span()
                    while a < b and flat[a] == " ":
                        a += 1
                    while b > a and flat[b - 1] == " ":
                        b -= 1
                    if flat[a - 1] != " " or flat[b] != " ":
                        a, b = flat.rfind(" ", 0, a) + 1, flat.find(" ", b)
                        if abs((b - a) - len(phrase)) > k:
                            continue
                    if not holds(norm[a:b].split(), wanted):
                        continue
                    first, edits = norm.count(b" ", 0, a) - 1, sum(hit.fuzzy_counts)
                    key = (label, first)
                    if key not in spans or edits < spans[key]["edits"]:
                        spans[key] = {"label": label, "first": first, "words": flat.count(" ", a, b) + 1, "edits": edits, "score": 1 - edits / len(phrase), "text": norm[a:b].decode("utf-8", "replace")}
        # of spans on the same words the surest stays; where several licenses fit as well, none
        meet = lambda s, t: s["first"] < t["first"] + t["words"] and t["first"] < s["first"] + s["words"] and s["label"] != t["label"]
        rank = lambda s: (-s["score"], -s["words"])
        kept: list[dict] = []
        for s in sorted(spans.values(), key=lambda s: (*rank(s), s["label"], s["first"])):
            if not any(meet(s, t) for t in kept) or any(meet(s, t) and rank(s) == rank(t) for t in kept):
                kept.append(s)
        kept = [s for s in kept if not any(meet(s, t) and rank(s) == rank(t) for t in kept)]
        return len(words), sorted(places), labels, sorted(kept, key=lambda s: (s["first"], s["label"]))


_OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int32()), ("edits", pa.int32()), ("score", pa.float64()), ("text", pa.string())])))]
)


def license_notices(docs: DataFrame, notices=NOTICES, base=BASE, share: float = 0.1) -> DataFrame:
    """One row per document with its words, exact base places, labels, best score and fuzzy spans.

    ``share`` of a notice's characters may differ, but none of its numbers and telling words. Null texts count as empty and give zeros, null places
    and empty labels; repeated rows and ids stay; an empty table gives no rows; texts are searched whole;
    spans starting at one word under one label keep the fewest edits, and of overlapping spans of several
    labels the surest stays, or none if they fit equally. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner(notices, base, share)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo in range(0, len(ids), 500):
                rows = []
                for doc, text in zip(ids[lo : lo + 500], batch.column("text").slice(lo, 500).to_pylist()):
                    n, places, labels, spans = scanner.scan(text or "")
                    rows.append({
                        "doc_id": doc, "n_words": n, "n_base": len(places), "first_word": places[0] if places else None, "last_word": places[-1] if places else None,
                        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
                        "score": 1.0 if places else max((s["score"] for s in spans), default=0.0), "spans": spans,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
