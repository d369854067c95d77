import random
from collections import Counter

import numpy as np
import pytest
from conftest import ODD, edited, prose

from sluice.llm import near_dedup, substring_dedup
from sluice.llm.common import components


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts):
    """Class of each text by comparing all pairs."""
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            either = sum((bags[i] | bags[j]).values())
            if either and 5 * both >= 4 * either:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def family():
    """Chains and clouds of near copies, exact copies, and unrelated texts."""
    r = random.Random(8)
    texts = [prose(r, r.randint(20, 120)) for _ in range(60)]
    base = prose(r, 150)
    texts += [edited(r, base, 0.02) for _ in range(60)]
    step = prose(r, 200)
    for _ in range(12):  # each is near the one before it, the ends are not near each other
        step = edited(r, step, 0.012)
        texts.append(step)
    texts += [texts[0]] * 25 + [texts[61]] * 5 + ODD
    order = list(range(len(texts)))
    r.shuffle(order)
    return [texts[i] for i in order]


def test_near_duplicates(make, family):
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(make(family)).collect()}
    wanted = classes(family)
    assert [got[i]["class_id"] for i in range(len(family))] == wanted
    sizes = Counter(wanted)
    for i, c in enumerate(wanted):
        assert got[i]["class_size"] == sizes[c] and got[i]["kept"] == (i == c)


def test_blocks_give_the_same(make, family, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(make(family)).collect()}
    assert [got[i] for i in range(len(family))] == classes(family)


def test_deduplicate(make, family):
    docs = make(family + family[:10], list(range(len(family))) + list(range(10)))
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [x["doc_id"] for x in kept.collect()]
    wordless = sum(not (t or "").split() for t in family[:10])
    assert len(ids) == len(set(classes(family))) + wordless
    assert near_dedup.deduplicate(docs.where("doc_id < 0")).count() == 0


def test_signature_agreement_is_weighted_similarity():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 200).astype(np.uint64)
    a = np.concatenate([base, base[:50], base[:50]])  # weights 3 and 1
    b = np.concatenate([base[40:], base[:50], r.integers(0, 2**63, 30).astype(np.uint64)])
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    true = sum((ca & cb).values()) / sum((ca | cb).values())
    sig, has = near_dedup.dart_minhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 3, k=2000, darts=2000 * 9)
    assert has.tolist() == [True, True, False]
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    alone, _ = near_dedup.dart_minhash(a, np.zeros(len(a), int), 1, k=2000, darts=2000 * 3)  # fewer darts, then more: the same earliest ones
    assert (alone[0] == sig[0]).all()


def test_similar_is_exact():
    r = random.Random(9)
    a = [prose(r, 60) for _ in range(80)]
    b = [edited(r, t, s) for t, s in zip(a, [0, 0.01, 0.02, 0.03, 0.05] * 16)]
    wanted = []
    for x, y in zip(a, b):
        i, u = sum((bag(x) & bag(y)).values()), sum((bag(x) | bag(y)).values())
        wanted.append(5 * i >= 4 * u)
    assert near_dedup.similar([x.encode() for x in a], [x.encode() for x in b]).tolist() == wanted and 0 < sum(wanted) < 80


def test_components(spark):
    r = random.Random(10)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (9, 5), (7, 7)] + [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(200)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# -- passages ----------------------------------------------------------------------------------------------------------


def repeated(texts, n=50):
    """For each text, the words that lie in an exact run of ``n`` words which another text has too."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict = {}
    for i, w in enumerate(words):
        for j in range(len(w) - n + 1):
            seen.setdefault(tuple(w[j : j + n]), set()).add(i)
    return [{j + k for j in range(len(w) - n + 1) if len(seen[tuple(w[j : j + n])]) > 1 for k in range(n)} for w in words]


def planted():
    r = random.Random(11)
    shared, line = [prose(r, n) for n in (55, 80, 200)], prose(r, 12)
    texts = [prose(r, r.randint(30, 300)) for _ in range(40)]  # clean
    for i in range(30):
        p = shared[i % 3]
        texts.append(f"{prose(r, r.randint(0, 80))} {p} {prose(r, r.randint(0, 80))}")
    texts += [f"{prose(r, 20)} {line} {prose(r, 20)}" for _ in range(60)]  # a short line that many share
    texts += [edited(r, shared[2], 0.04) for _ in range(3)]  # fuzzy
    texts += [f"{prose(r, 10)} " + "is one. " * 60 + prose(r, 10) for _ in range(6)]  # periodic
    texts += [texts[0]] * 4 + [prose(r, 60) * 2]
    return texts + ODD


def test_passages():
    assert substring_dedup.common_subsequence("a b c d e".split(), "b x d e".split()) == 3
    x = [0, 8, 16, 24, 32, 40, 200]
    assert substring_dedup.chains(x, [5, 13, 21, 29, 37, 45, 900])[0] == (0, 40, 5, 45)
    crossed = substring_dedup.chains([0, 10, 20, 30, 40, 50], [50, 60, 70, 0, 10, 20])
    assert all(b >= a and d >= c for a, b, c, d in crossed)


def test_fenwick_chains_are_optimal():
    r = random.Random(12)
    for _ in range(60):
        n = r.randint(1, 14)
        x, y = sorted(r.randrange(80) for _ in range(n)), [r.randrange(80) for _ in range(n)]
        best = [substring_dedup.GAIN] * n
        for i in range(n):
            for j in range(i):
                if x[j] < x[i] and y[j] < y[i]:
                    best[i] = max(best[i], best[j] + substring_dedup.GAIN - substring_dedup.GAP * (x[i] - x[j] + y[i] - y[j]))
        found = substring_dedup.chains(x, y)
        top = max(range(n), key=lambda i: best[i])
        spans = [c for c in found if c[1] == x[top] and c[3] == y[top]]
        long_enough = any(x[top] + substring_dedup.SEED - a >= substring_dedup.LEAST_SPAN for a, b, c, d in spans)
        assert not spans or long_enough


def test_repeated_passages(make):
    texts = planted()
    got = substring_dedup.repeated_passages(make(texts)).collect()
    cover = [set() for _ in texts]
    for x in got:
        cover[x["doc_id"]] |= set(range(x["start_word"], x["end_word"]))
        assert x["n_words"] == x["end_word"] - x["start_word"] >= 50 and x["partner_id"] is not None
    wanted = repeated(texts)
    for i, w in enumerate(wanted):
        assert w <= cover[i], (i, len(w - cover[i]))
    assert not any(cover[1:40]) and not any(cover[70:130])  # clean texts, and those that share a short line only
    assert all(cover[130:133])  # fuzzy ones
    firsts = {x["doc_id"] for x in got if x["kept"]}
    assert firsts and len(firsts) < len({x["doc_id"] for x in got})


def test_passages_of_nothing(make):
    assert substring_dedup.repeated_passages(make(["x"]).where("doc_id < 0")).count() == 0
    assert substring_dedup.repeated_passages(make([None, "", "a b"])).count() == 0
