"""License scans by a positional rare-token index, in DataFrame operations only.

Words are lower-cased runs of letters, digits and non-ASCII characters. Each template (a licence notice) is indexed
by its rarest words, rarity being the inverse document frequency over the whole table. A file looks up all the index
words it has; the postings give (template, position in template), and those that agree in the difference of positions
vote for one placement. A placement with enough votes is verified: the template's mandatory key phrase has to
stand there word by word. Its score is the share of the template's words that stand where it puts them.

Defined results: a null text counts as empty; a text without words has count 0, null positions, empty labels and
score 0; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import written

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# The method's templates as label, notice, mandatory key phrase.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0-1.0", "this work has been dedicated to the public domain under creative commons cc0 1 0 universal", "commons cc0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee is hereby granted"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("proprietary", "all rights reserved", "rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)

#: Index words a template, votes a placement needs.
INDEX_WORDS, VOTES = 4, 2

VOCABULARY = tuple(sorted({w for _, text, _ in TEMPLATES for w in text.split()} | {w for p, _ in BASE for w in p.split()}))
_CODE = {w: i for i, w in enumerate(VOCABULARY)}
#: A hit is position * _STEP + the word's code.
_STEP = 256
assert len(VOCABULARY) <= _STEP


def _words(text: Column) -> Column:
    # The Kelvin sign is the one non-ASCII character whose lower case is an ASCII letter.
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é"))
    return F.regexp_extract_all(F.lower(kept), F.lit(WORDS), F.lit(0))


def hits(docs: DataFrame) -> DataFrame:
    """_row, doc_id, n_words, and where words of the vocabulary stand, as position * 256 + code."""
    spelled = F.array(*[F.lit(w) for w in VOCABULARY])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("_w"))
    n = F.size("_w").cast("long")
    places = F.filter(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.get("_w", i.cast("int")).isin(*VOCABULARY))
    coded = F.transform(places, lambda i: i * _STEP + F.array_position(spelled, F.get("_w", i.cast("int"))) - 1)
    return rows.select("_row", "doc_id", n.alias("n_words"), coded.alias("hits"))


def _coded(words: list[tuple[int, str]]) -> Column:
    """Words and their positions as hits, to which an offset can be added."""
    return F.array(*[F.lit(k * _STEP + _CODE[w]).cast("long") for k, w in words])


def _places(found: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other: they are all hits, so their hits are neighbours."""
    codes = [_CODE[w] for w in phrase.split()]

    def stands(j: Column) -> Column:
        h, out = F.get(found, j), F.get(found, j) % _STEP == codes[0]
        for k, c in enumerate(codes[1:], 1):
            out = out & (F.get(found, j + k) == h + (k * _STEP + c - codes[0]))
        return out

    starts = F.when(F.size(found) >= len(codes), F.sequence(F.lit(0), F.size(found) - len(codes))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(starts, stands), lambda j: F.floor(F.get(found, j) / _STEP).cast("long"))


def _at_or_after(found: Column, low: Column) -> Column:
    """How many hits are less than ``low``: a binary search, as hits ascend."""

    def half(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        below = (s["lo"] < s["hi"]) & (F.get(found, middle) < low)
        lo, hi = F.when(below, middle + 1).otherwise(s["lo"]), F.when(below, s["hi"]).otherwise(middle)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), F.size(found).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(found)))), whole, half, lambda s: s["lo"])


def base_columns(found: DataFrame) -> DataFrame:
    """The base phrases' counts, ends and labels beside ``found``'s columns."""
    out = found.withColumns({f"_p{i}": _places(F.col("hits"), p) for i, (p, _) in enumerate(BASE)})
    every = F.concat(*[F.col(f"_p{i}") for i in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    return out.withColumns(
        {"n_base": F.size(every).cast("long"), "first_word": F.array_min(every), "last_word": F.array_max(every), "_base": F.array_sort(labels)}
    ).drop(*[f"_p{i}" for i in range(len(BASE))])


def rarity(found: DataFrame) -> list[float]:
    """The inverse document frequency of each word of the vocabulary (one number a word is collected)."""
    n = found.count()
    seen = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h % _STEP))).alias("c")).groupBy("c").count().collect()
    df = {int(r["c"]): r["count"] for r in seen}
    return [math.log((1 + n) / (1 + df.get(i, 0))) for i in range(len(VOCABULARY))]


def index(idf: list[float], size: int = INDEX_WORDS) -> dict[int, list[tuple[int, int]]]:
    """Postings of each template's rarest words: code to (template, position)."""
    out: dict[int, list[tuple[int, int]]] = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        rare = sorted(set(words), key=lambda w: (-idf[_CODE[w]], w))[:size]
        for p, w in enumerate(words):
            if w in rare:
                out.setdefault(_CODE[w], []).append((t, p))
    return out


def placements(found: DataFrame, idf: list[float]) -> DataFrame:
    """_row, template, offset (may be negative): where enough of the index words agree."""
    postings = index(idf)
    rows = found.select("_row", F.explode(F.filter("hits", lambda h: (h % _STEP).isin(*sorted(postings)))).alias("_h"))
    entries = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in postings.get(c, [])]).cast("array<struct<t:int,p:int>>") for c in range(len(VOCABULARY))])
    votes = rows.select("_row", F.floor(F.col("_h") / _STEP).cast("long").alias("_pos"), F.explode(F.get(entries, (F.col("_h") % _STEP).cast("int"))).alias("_e"))
    need = F.array(*[F.lit(min(VOTES, len(text.split()))) for _, text, _ in TEMPLATES])
    return (
        votes.select("_row", F.col("_e.t").alias("template"), (F.col("_pos") - F.col("_e.p")).alias("offset"))
        .groupBy("_row", "template", "offset").agg(F.count("*").alias("votes"))
        .where(F.col("votes") >= F.get(need, F.col("template")))
    )


def verified(found: DataFrame, placed: DataFrame) -> DataFrame:
    """_row, added (labels), score: the placements whose mandatory phrase stands where they put it."""
    grouped = placed.groupBy("_row").agg(F.collect_list(F.struct("template", "offset")).alias("_placed"))
    wording, phrases = [], []
    for _, text, phrase in TEMPLATES:
        words = text.split()
        at = len(f" {text} "[: f" {text} ".index(f" {phrase} ")].split())
        wording.append(_coded(list(enumerate(words))))
        phrases.append(_coded([(at + k, w) for k, w in enumerate(phrase.split())]))
    longest = max(len(text.split()) for _, text, _ in TEMPLATES)
    names = F.array(*[F.lit(name) for name, _, _ in TEMPLATES])

    def checked(p: Column) -> Column:
        low = p["offset"] * _STEP
        near = F.slice("hits", _at_or_after(F.col("hits"), low) + 1, longest)  # all hits that a template there can have
        stands = lambda w: F.array_contains(near, low + w)
        wanted = F.get(F.array(*wording), p["template"])
        share = F.size(F.filter(wanted, stands)) / F.size(wanted)
        return F.struct(F.get(names, p["template"]).alias("label"), F.when(F.forall(F.get(F.array(*phrases), p["template"]), stands), share).alias("score"))

    both = found.select("_row", "hits").join(grouped, "_row").select("_row", F.filter(F.transform("_placed", checked), lambda x: x["score"].isNotNull()).alias("_found"))
    return both.where(F.size("_found") > 0).select("_row", F.array_distinct(F.col("_found.label")).alias("added"), F.array_max(F.col("_found.score")).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    found = written(hits(docs), "license-hits")
    idf = rarity(found)
    added = verified(found, placements(found, idf))
    rows = base_columns(found).drop("hits").join(added, "_row", "left")
    labels = F.array_sort(F.array_union(F.col("_base"), F.coalesce("added", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
