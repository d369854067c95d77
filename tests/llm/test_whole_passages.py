"""Repeated passages that a text pair or the choice of pivots must not hide."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import edited, prose
from pyspark.sql import functions as F
from test_dedup import repeated

from sluice.llm import substring_dedup
from sluice.llm.common import SLICE_BYTES, hash_words, split_words, window_hashes


def check(make, texts):
    cover = [set() for _ in texts]
    for x in substring_dedup.repeated_passages(make(texts)).collect():
        cover[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
        assert x["partner_id"] is not None and x["n_words"] >= 50
    wanted = repeated(texts)
    assert any(wanted)
    for i, w in enumerate(wanted):
        assert w <= cover[i], (i, len(w - cover[i]))


def words(r, n):
    """``n`` words, never fewer: prose() glues some."""
    return " ".join(prose(r, 2 * n).split()[:n])


def test_two_passages_in_one_pair(make):
    r = random.Random(31)
    texts = []
    for gap in range(30, 161, 10):
        for both in (True, False):
            for _ in range(2):
                p, q = words(r, 55), words(r, 55)
                texts += [f"{words(r, 20)} {p} {words(r, gap)} {q} {words(r, 20)}", f"{words(r, 20)} {p} {words(r, gap) if both else ''} {q} {words(r, 20)}"]
    check(make, texts)


def test_bridged_chain_is_split():
    r = random.Random(32)
    p, q = words(r, 55).split(), words(r, 55).split()
    a, b = [w.encode() for w in p + words(r, 100).split() + q], [w.encode() for w in p + words(r, 100).split() + q]
    at = [0, 12, 24, 36, 48, 155, 167, 179, 191, 203]
    assert substring_dedup.passages(a, b, at, at) == [(0, 55, 0, 55), (155, 210, 155, 210)]


@pytest.mark.parametrize("seed", [33, 34])
def test_passage_whose_seeds_all_have_other_pivots(make, seed):
    r = random.Random(seed)
    p = words(r, 60)
    texts = [f"{words(r, 25)} {p} {words(r, 25)}" for _ in range(2)]
    for k in range(0, 36, 2):  # every part of it is frequent elsewhere, but none of them is long enough to be compared
        part = " ".join(p.split()[k : k + 25])
        texts += [f"{words(r, 25)} {part} {words(r, 25)}" for _ in range(12)]
    check(make, texts)


def test_edited_passages_between_frequent_clauses(make):
    r = random.Random(35)
    clauses = [words(r, 14) for _ in range(4)]
    texts, planted = [], []
    for _ in range(40):  # each passage in three texts, one word in twenty changed, and clauses that all texts share around it
        p = f"{words(r, 40)} {r.choice(clauses)} {words(r, 40)}"
        for _ in range(3):
            before, q = f"{words(r, 20)} {r.choice(clauses)} {words(r, 20)}", edited(r, p, 0.05)
            planted.append((len(before.split()), len(before.split()) + len(q.split())))
            texts.append(f"{before} {q} {words(r, 20)} {r.choice(clauses)}")
    cover = [set() for _ in texts]
    for x in substring_dedup.repeated_passages(make(texts)).collect():
        cover[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    caught = sum(len(c & set(range(a, b))) >= 0.8 * (b - a) for c, (a, b) in zip(cover, planted))
    beside = sum(len(c - set(range(a - 6, b + 6))) for c, (a, b) in zip(cover, planted))
    print(caught, len(planted), beside)
    assert caught >= 0.9 * len(planted) and beside == 0


def pairwise(texts):
    """The places of shared seeds that a passage of any two texts covers, by chaining and aligning every pair."""
    flat, counts = split_words([t.encode() for t in texts])
    h, owner, pos = window_hashes(hash_words(flat), counts, substring_dedup.SEED)
    keep = substring_dedup.winnow(h, owner, pos)
    h, owner, pos = substring_dedup.numbered(h[keep], owner[keep], pos[keep])
    places = [{} for _ in texts]
    for s, i, at in zip(h.tolist(), owner.tolist(), pos.tolist()):
        places[i].setdefault(s, []).append(at)
    shared = {s for s, n in Counter(s for p in places for s in p).items() if n > 1}
    words_, out = [t.encode().split() for t in texts], [set() for _ in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        xy = sorted((x, y) for s in places[i].keys() & places[j].keys() for x in places[i][s] for y in places[j][s])
        x, y = [a for a, _ in xy], [b for _, b in xy]
        for c in substring_dedup.linked(x, y):
            for x0, x1, y0, y1 in substring_dedup.passages(words_[i], words_[j], [x[k] for k in c], [y[k] for k in c]):
                for t, a, b in ((i, x0, x1), (j, y0, y1)):
                    out[t] |= {at for s in places[t].keys() & shared for at in places[t][s] if a <= at < b}
    return out


@pytest.mark.parametrize("seed, share", [(36, 0.08), (37, 0.08), (38, 0.11)])
def test_partners_that_are_no_pivots(make, seed, share):
    r = random.Random(seed)
    clauses = [words(r, 16) for _ in range(3)]
    texts = []
    for _ in range(30):  # two edited copies of each passage, between clauses that all texts share, so pivots are other texts
        p = f"{words(r, 12)} {r.choice(clauses)} {words(r, 12)} {r.choice(clauses)} {words(r, 12)}"
        texts += [f"{words(r, 20)} {edited(r, p, share)} {words(r, 20)}" for _ in range(2)]
    cover = [set() for _ in texts]
    for x in substring_dedup.repeated_passages(make(texts)).collect():
        cover[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    wanted = pairwise(texts)
    lost = [(i, sorted(w - c)) for i, (w, c) in enumerate(zip(wanted, cover)) if w - c]
    print(sum(map(len, wanted)), sum(len(x) for _, x in lost))
    assert any(wanted) and not lost


def test_texts_that_share_a_short_clause_do_not_all_meet(make, monkeypatch):
    r, tables = random.Random(39), []
    written = substring_dedup.written

    def seen(df, name):
        out = written(df, name)
        if name in ("substring-keys", "substring-chains"):
            tables.append((name, out, out.select("t", "key").distinct().collect() if name == "substring-keys" else []))
        return out

    monkeypatch.setattr(substring_dedup, "written", seen)
    clause, n = words(r, 22), 80
    texts = []
    for _ in range(n // 2):  # the clause is too short for a chain, and what two texts share after it too short for a passage
        after = words(r, 14)
        texts += [f"{words(r, 60)} {clause} {words(r, 12)} {after} {words(r, 60)}" for _ in range(2)]
    p = words(r, 60)
    texts += [f"{words(r, 20)} {p} {words(r, 20)}" for _ in range(2)]
    check(make, texts)
    sharing = Counter(x["key"] for name, _, rows in tables for x in rows)
    assert sum(k * (k - 1) for k in sharing.values()) < 8 * n, max(sharing.values())
    # and what a pass has made is deleted after it
    for name, table, _ in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0])
        assert name == "substring-keys" or not path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).exists(path)


def test_a_text_goes_to_the_workers_once_a_step(make, monkeypatch):
    r, sent = random.Random(40), []
    parts = [words(r, 60) for _ in range(40)]
    texts = [" ".join(f"{p} {words(r, 40)}" for p in parts), *(f"{words(r, 20)} {p} {words(r, 20)}" for p in parts)]
    docs, whole = make(texts), sum(map(len, texts))
    mapped = type(docs).mapInArrow

    def seen(df, *args, **more):
        for c in {"text", "_text"} & set(df.columns):
            sent.append(df.agg(F.sum(F.length(c))).first()[0] or 0)
        return mapped(df, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", seen)
    cover = [set() for _ in texts]
    for x in substring_dedup.repeated_passages(docs).collect():
        cover[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
    assert sent and max(sent) <= whole, (sent, whole)
    assert all(w <= c for w, c in zip(repeated(texts), cover))


def test_ranges_of_long_texts_leave_in_small_batches():
    text = " ".join(f"w{i}" for i in range(20_000))
    n = 400  # ranges of nearly all of the text, as near copies of it ask for
    rb = pa.RecordBatch.from_pylist([{"k": 1, "ranges": [{"lo": i, "hi": 19_000 + i} for i in range(n)], "text": text}, {"k": 2, "ranges": [{"lo": 50, "hi": 60}], "text": text}])
    rows, ends = [], []
    for out in substring_dedup.cuts(iter([rb])):
        assert out.nbytes <= 2 * SLICE_BYTES
        ends.append(out.num_rows)
        rows += out.to_pylist()
    assert len(ends) > 1 and [(x["k"], x["lo"], x["hi"]) for x in rows] == [*((1, i, 19_000 + i) for i in range(n)), (2, 50, 60)]
    for x in rows[:2] + rows[-2:]:
        first = max(0, x["lo"] - substring_dedup.MARGIN)
        assert x["first"] == first and x["words"].decode().split() == text.split()[first : x["hi"] + substring_dedup.SEED + substring_dedup.MARGIN]


def test_extensions_of_many_pairs_are_those_of_each():
    r = random.Random(41)
    rows = [[r.randint(1, r.choice((2, 9, 99))) for _ in range(r.choice((0, 3, 10, 40)))] for _ in range(150)]
    for base in rows[:]:  # edited copies, so that some run on for long
        other = [x if r.random() > 0.15 else r.randint(100, 999) for x in base if r.random() > 0.05]
        rows.append(other)
    marks = np.zeros((len(rows), 42), np.uint16)
    for k, x in enumerate(rows):
        marks[k, : len(x)] = x
    pairs = [(k, k + 150) for k in range(150)] + [(r.randrange(300), r.randrange(300)) for _ in range(3000)]
    a, b = (np.array(x) for x in zip(*pairs))
    got = list(zip(*(x.tolist() for x in substring_dedup.extensions(marks, a, b))))
    assert got == [substring_dedup._extension(rows[x], rows[y]) for x, y in pairs] and max(got)[0] > 30


def test_texts_that_share_a_clause_make_no_chains_of_all_pairs(make, monkeypatch):
    r, chained = random.Random(42), []
    written = substring_dedup.written

    def seen(df, name):
        out = written(df, name)
        if name == "substring-chains":
            chained.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "written", seen)
    clause, n = words(r, 42), 60
    # long enough for a chain, too short for a passage
    texts = [f"{words(r, 60)} {clause} {words(r, 60)}" for _ in range(n)]
    p = words(r, 60)
    texts += [f"{words(r, 20)} {p} {words(r, 20)}", f"{words(r, 20)} {edited(r, p, 0.03)} {words(r, 20)}"]
    texts += [f"{words(r, 20)} {clause} {p} {words(r, 20)}" for _ in range(2)]
    check(make, texts)
    assert chained[-1] < 4 * n, chained
