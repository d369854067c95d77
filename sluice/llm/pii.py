"""Personal data: fixed patterns, and identifiers that a bootstrapped contextual extractor adds.

The fixed patterns find e-mail addresses, IP addresses, card and phone numbers. They, and long hexadecimal
credentials, are the seeds of the bootstrap. Each seed and each other identifier-like token is an instance; the two
words before it are its lexical pattern. Spark scores the bipartite graph of patterns and instances in rounds: a
pattern is worth the share of its distinct instances that are believed in, an instance is believed in as far as its
patterns are. Patterns with enough support and a high share then extract the instances that no fixed pattern knows,
at each place where they stand, with words before it or without. Tokens of fewer than 8 characters or 4 digits are no
instances, whatever stands before them.

Defined results: a null text counts as empty; an empty text has no spans and the digest of the empty string;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored (``find``) or kept
(``redact``). Spans are in code points, end exclusive, and the extractor's never overlap the fixed patterns'. Only the
``CONTEXT`` code points before an identifier are its context.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import free_name, text_ranges, written

KINDS = ("email", "ip", "card", "phone", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}

# The patterns of the base kinds.
# An e-mail address is searched from its @ outwards, and digits are not given back: a long run costs no more than its length.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]+")
_EDGE = "\"'`.,;:!?()[]{}<>|#*$%&="
_HEX = re.compile(r"(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,64}")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_PLAIN = re.compile(r"[^\w=:]+")
#: Code points before an instance in which its two context words are looked for.
CONTEXT = 80

#: Rounds of scoring; believed instances a pattern needs; share of a pattern's instances that are believed in.
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost first, none over another."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by start and then kind."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], _RANK[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def context(text: str, start: int) -> str:
    """The two words before a place, without case, digits and decoration: a lexical pattern."""
    before = text[max(0, start - CONTEXT) : start].rstrip(" \t\n\r\x0b\x0c" + "\"'`([{<").split()[-2:]
    words = []
    for w in before:
        w = _PLAIN.sub("", w.lower())
        if w:
            words.append(_DIGIT.sub("0", w))
    return " ".join(words)


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, str]]:
    """Instances of a text: pattern ('' without words before it), hash of the identifier, start, end, and the kind if it is a seed, else ''."""
    out = [(context(text, a), a, b, k) for k, a, b in spans]
    starts, reach = [a for _, a, _ in spans], list(accumulate((b for _, _, b in spans), max))
    at = 0
    for m in _DIGIT.finditer(text):
        if m.start() < at:
            continue
        a, b = m.span()
        while a > at and not _BLANK.match(text, a - 1):
            a -= 1
        end = _BLANK.search(text, b)
        at = b = end.start() if end else len(text)
        token = text[a:b]
        core = token.strip(_EDGE)
        if "=" in core or ":" in core:  # key=value: the value is the identifier, the key its context
            core = re.split(r"[=:]+", core)[-1].strip(_EDGE)
        if len(core) < 8 or len(_digits(core)) < 4:
            continue
        a = text.rindex(core, a, b)
        b = a + len(core)
        k = bisect_left(starts, b)  # spans that start before the token's end; do they reach beyond its start?
        if k and reach[k - 1] > a:
            continue
        out.append((context(text, a), a, b, "secret" if _HEX.fullmatch(core) else ""))
    return [(p, _instance(text, a, b), a, b, k) for p, a, b, k in out]


def _instance(text: str, a: int, b: int) -> int:
    return xxhash.xxh3_64_intdigest(text[a:b].lower().encode()) - (1 << 63)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_CAND = pa.struct([("pattern", pa.string()), ("inst", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.string())])
_FOUND = (
    "_row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<kind:string,start:int,end:int>>, cands array<struct<pattern:string,inst:long,start:int,end:int,seed:string>>"
)


def scan(docs: DataFrame, row: str = "_row") -> DataFrame:
    """The fixed patterns' spans and the instances of each text; ``row`` names the column that tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for start, stop in text_ranges(rb.column("text")):
                yield scanned(rb.slice(start, stop - start))

    def scanned(rb: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in rb.column("text").to_pylist():
            spans = base_spans(t or "")
            n = {k: sum(s[0] == k for s in spans) for k in KINDS}
            digest = hashlib.sha256(joined(spans).encode()).hexdigest()
            rows.append((n["email"], n["ip"], n["card"], n["phone"], digest, [dict(zip(("kind", "start", "end"), s)) for s in spans], [dict(zip(("pattern", "inst", "start", "end", "seed"), c)) for c in (candidates(t, spans) if t else [])]))
        cols = list(zip(*rows)) if rows else [()] * 7
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.list_(_CAND))
        return pa.RecordBatch.from_arrays(
            [rb.column("_row"), rb.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))],
            names=["_row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "cands"],
        )

    return docs.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Scores the graph of patterns and instances. Returns inst, kind of the instances that strong patterns extract."""
    occurrences = found.select(F.explode("cands").alias("c")).select("c.*")
    edges = written(occurrences.where("pattern <> ''").groupBy("pattern", "inst").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = edges.groupBy("inst").agg(F.max("seed").alias("seed"))
    believed = seeds.select("inst", "seed", (F.col("seed") != "").cast("double").alias("s"))
    for _ in range(rounds):
        scored = edges.select("pattern", "inst").join(believed, "inst")
        worth = scored.groupBy("pattern").agg(
            F.sum("s").alias("mass"), (F.sum("s") / (F.count("*") + 0.5)).alias("share"),
            *[F.sum(F.when(F.col("seed") == k, F.col("s")).otherwise(0.0)).alias(k) for k in KINDS],
        )
        strong = worth.where((F.col("mass") >= support) & (F.col("share") >= confidence)).select(
            "pattern", "share", F.element_at(F.array_sort(F.array(*[F.struct((-F.col(k)).alias("m"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(KINDS)])), 1)["k"].alias("kind")
        )
        reached = edges.select("pattern", "inst").join(strong, "pattern").groupBy("inst").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("share", F.lit(0.999)))))).alias("by"), F.max_by("kind", F.struct("share", "kind")).alias("kind")
        )
        believed = written(
            seeds.join(reached, "inst", "left").select(
                "inst", F.when(F.col("seed") != "", F.col("seed")).otherwise(F.coalesce("kind", F.lit(""))).alias("seed"),
                F.greatest((F.col("seed") != "").cast("double"), F.coalesce("by", F.lit(0.0))).alias("s"), F.coalesce("by", F.lit(0.0)).alias("by"),
            ), "pii-scores",
        )
    return believed.where(F.col("by") >= confidence).select("inst", F.col("seed").alias("kind"))


def added_spans(found: DataFrame, extracted: DataFrame) -> DataFrame:
    """_row, more: the extractor's spans of each row that has any; those that a fixed pattern has found already are left out."""
    occurrences = found.select("_row", F.explode("cands").alias("c")).select("_row", "c.inst", "c.start", "c.end", "c.seed")
    new = occurrences.where(F.col("seed").isin("", "secret"))
    return new.join(extracted, "inst").groupBy("_row").agg(F.collect_set(F.struct("kind", "start", "end", "inst")).alias("more"))


def _all_spans(base, more):
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    more = F.transform(more, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.concat(base, F.coalesce(more, F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _found(docs: DataFrame) -> DataFrame:
    return written(scan(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")), "pii-spans")


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts and digest of the fixed patterns' spans, all spans, and how many these are, for each row."""
    found = _found(docs)
    more = added_spans(found, bootstrap(found, **options))
    spans = _all_spans(F.col("base"), F.col("more"))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.drop("cands").join(more, "_row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span's code points replaced by its kind; of overlapping spans the first gives the name."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], _RANK[s[0]])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by the name of its kind, and ``n_chars``, if it is there, set anew.

    Texts meet the extractor's spans by a hash, and each span is checked against its text; the fixed patterns'
    spans are found again in place.
    """
    key, extra = free_name(docs, "_pii_key"), free_name(docs, "_pii_more")
    found = written(scan(docs.select(F.xxhash64("text").alias("_row"), "doc_id", "text")), "pii-spans")
    more = added_spans(found, bootstrap(found, **options)).select(F.col("_row").alias(key), F.col("more").alias(extra))
    joined_ = docs.withColumn(key, F.xxhash64("text")).join(more, key, "left")
    names = docs.columns
    resize = "n_chars" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in text_ranges(whole.column("text")):
                rb, texts = whole.slice(start, stop - start), []
                for t, m in zip(rb.column("text").to_pylist(), rb.column(extra).to_pylist()):
                    if t:
                        spans = base_spans(t) + [(s["kind"], s["start"], s["end"]) for s in m or [] if _instance(t, s["start"], s["end"]) == s["inst"]]
                        t = masked(t, spans) if spans else t
                    texts.append(t)
                cols = {c: rb.column(c) for c in names}
                cols["text"] = pa.array(texts, pa.string())
                if resize:
                    cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return joined_.drop(key).mapInArrow(run, docs.schema)
