import math
import random
import re

import numpy as np
import pytest
from conftest import ODD, prose

from sluice.llm import licenses, mixing, topk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, _v int, rank string")


def exact(rows, every, k):
    good = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for n, (i, v) in enumerate(good):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v))
            out += [(i, r, j, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(256, 4096), (3, 17)])
def test_topk(spark, blocks):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(10)], 0, 1, "x") for i in range(300)]
    hot = [0.5] * 10
    rows += [(1000 + i, hot, 0, 1, "x") for i in range(60)]  # one vector many times: ties go to smaller ids
    rows += [rows[0], rows[7], (None, hot, 0, 1, "x"), (2001, None, 0, 1, "x"), (2002, [None] * 10, 0, 1, "x"), (2003, [float("nan")] * 10, 0, 1, "x"), (2004, [float("inf")] * 10, 0, 1, "x")]
    rows += [(2020, [1.0, 2.0], 0, 1, "x"), (2021, [1.0, -2.0], 0, 1, "x"), (2040, [], 0, 1, "x")]
    got = topk.top_k(vectors(spark, rows), 20, 5, *blocks)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == exact(rows, 20, 5)


def test_topk_of_large_components(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) * 10.0 ** r.randint(0, 11) for _ in range(4)], 0, 1, "x") for i in range(60)]
    got = topk.top_k(vectors(spark, rows), 5, 4)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == exact(rows, 5, 4)
    rows = [(0, [1e30, 0.0], 0, 1, "x"), (1, [1.0, 1.0], 0, 1, "x"), (2, [-3e38, 2.0], 0, 1, "x"), (3, [2.0, 0.0], 0, 1, "x"), (4, [0.0, 5.0], 0, 1, "x")]
    got = topk.top_k(vectors(spark, rows), 100, 5).orderBy("rank").collect()
    assert [(x["vec_id"], x["score"]) for x in got] == [(3, 2**63 - 1), (1, 2**63 - 1), (4, 0), (2, -(2**63))]


def test_topk_sends_few_entries(spark):
    r = random.Random(7)
    centers = [[r.gauss(0, 0.2) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centers[i % 40]], 0, 1, "x") for i in range(2000)]
    phases = topk.Phases(vectors(spark, rows), 50, 10, 16, 256)
    pairs = phases.n_queries * phases.n_vectors
    assert phases.n_queries == 40 and phases.lists.count() == topk.SLICES * 10 * 40
    entries, left = phases.entries.count(), phases.open.count()
    assert entries < pairs / 5 and left < pairs / 10, (pairs, entries, left)


def test_topk_of_nothing(spark):
    assert topk.top_k(vectors(spark, []), 2).count() == 0


def test_products_are_exact():
    a = np.array([[2**40, 3], [-(2**30), 5]], np.int64)
    assert (topk.products(a[1:], a[1:]) == np.array([[2**60 + 25]])).all()
    assert (topk.products(np.array([[3, 4]]), np.array([[5, 6]])) == [[39]]).all()
    assert topk.products(np.array([[2**60, 1]]), np.array([[2**60, 3]]))[0, 0] == 2**120 + 3


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 300 * 5 / 8, "b": 75.0, "c": 37.5}
    t = mixing.targets({"a": 10, "b": 100, None: 100})
    assert t["a"] == 30 and abs(t["b"] - 120) < 1e-9 and abs(t[None] - 60) < 1e-9
    assert mixing.targets({"a": 0, "b": 9}) == {"a": 0.0, "b": 9.0}
    assert mixing.targets({"a": 0}) == {"a": 0.0}
    by_code_point = mixing.targets({"\U0001f600": 100, "\uffff": 100})  # in UTF-16 the first would come first
    assert by_code_point["\uffff"] > by_code_point["\U0001f600"]


def test_pivot_keeps_mass_and_expectation():
    r = np.random.default_rng(1)
    size = r.integers(1, 50, 40)
    total = np.zeros(40)
    for _ in range(3000):
        out, left = mixing.pivot(size, np.full(40, 0.3), r.random(40))
        assert ((out == 0) | (out == 1) | (np.arange(40) == left)).all()
        assert abs((out * size).sum() - 0.3 * size.sum()) < 1e-6
        total += out
    assert abs(total / 3000 - 0.3).max() < 0.06


@pytest.mark.parametrize("chunk", [1024, 7])
def test_mixing(make, chunk):
    r = random.Random(6)
    texts = [prose(r, r.randint(1, 80)) for _ in range(400)] + ODD
    sources = [r.choice(["a", "b", "b", "b", None, "zz"]) for _ in texts]
    ids = list(range(300)) + [7] * (len(texts) - 300)
    docs = make(texts, ids, sources)
    docs = docs.unionAll(docs.where("doc_id = 3")).unionAll(docs.where("doc_id = 3"))
    got = mixing.mixing_plan(docs, chunk_rows=chunk, fan_in=4).collect()
    again = mixing.mixing_plan(docs.repartition(5), chunk_rows=chunk, fan_in=4).collect()
    assert len(got) == len(texts) + 2 and sorted(got) == sorted(again)
    sizes: dict = {}
    for t, s in list(zip(texts, sources)) + [(texts[3], sources[3])] * 2:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    goals = mixing.targets(sizes)
    taken: dict = {}
    for x in got:
        assert x["taken"] == x["copies"] * x["size"] and 0 <= x["copies"] <= 3
        taken[x["source_size"]] = taken.get(x["source_size"], 0) + x["taken"]
    assert len(set(sizes.values())) == len(sizes)
    for s, goal in goals.items():
        assert abs(taken[sizes[s]] - goal) <= max(len((t or "").encode().split()) for t, o in zip(texts, sources) if o == s)


def test_mix_repeats_rows(make):
    docs = make([prose(random.Random(i), 20) for i in range(60)], sources=["a"] * 6 + ["b"] * 54)
    docs = docs.unionAll(docs.where("doc_id = 1"))
    plan = {}
    for x in mixing.mixing_plan(docs).collect():
        plan[x["doc_id"]] = plan.get(x["doc_id"], 0) + x["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    found: dict = {}
    for x in mixed.collect():
        found[x["doc_id"]] = found.get(x["doc_id"], 0) + 1
    assert found == {i: n for i, n in plan.items() if n}
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0


def test_mixing_ignores_other_columns_and_deals_copies(make, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "COPIES", 3)
    docs = make([prose(random.Random(i), 20) for i in range(40)], sources=["a"] * 5 + ["b"] * 35)
    docs = docs.unionAll(docs.where("doc_id = 1")).crossJoin(docs.sparkSession.range(1)).drop("id")
    for _ in range(3):
        docs = docs.unionAll(docs.where("doc_id = 1"))  # 16 copies of one row
    plain = sorted(map(tuple, mixing.mixing_plan(docs.select("doc_id", "text", "source")).collect()))
    assert len(plain) == 55 and sorted(map(tuple, mixing.mixing_plan(docs.withColumn("lang", F.lit("zz")).withColumn("more", F.rand())).collect())) == plain
    assert mixing.mix(docs).count() == sum(x[-1] for x in plain)


def test_last_residual_is_drawn_at_random(make):
    n = 90  # one document a source: each is its source's last residual, with fractions 7/8, 3/4 and 3/8
    got = mixing.mixing_plan(make([f"w{k} " * 10 for k in range(n)], sources=[f"s{k:02}" for k in range(n)])).collect()
    more = [sum(x["copies"] - math.floor(x["target"] / 10) for x in got if x["doc_id"] % 3 == i) for i in range(3)]
    assert 20 <= more[0] <= 30 and 14 <= more[1] <= 29 and 4 <= more[2] <= 19


def license_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def by_hand(text):
    w = license_words(text)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(make):
    r = random.Random(7)
    notices = [
        "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    texts = ODD + [prose(r, 30) + "\n" + n + "\n" + prose(r, 10) for n in notices] + [prose(r, 20) for _ in range(40)]
    texts += ["cc by cc by-cc BY", "general public  license GENERAL PUBLIC LICENSE", "all rights are reserved", "ALL RIGHTſ RESERVED", "K all rights reserved", " ".join(notices * 400)]
    got = {x["doc_id"]: x for x in licenses.scan(make(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == by_hand(t), t
        assert 0 <= x["score"] <= 1 and set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(","))
        assert x["labels"] == ",".join(sorted(set(x["labels"].split(","))))
    for i, label in enumerate(["cc-by-nc-4.0", "apache-2.0", "proprietary", "mit", "gpl-3.0"]):
        assert label in got[len(ODD) + i]["labels"].split(",") and got[len(ODD) + i]["score"] == 1.0
    assert all(got[len(ODD) + 5 + i]["labels"] == "" for i in range(40))


def test_licenses_of_nothing_and_native(make):
    assert licenses.scan(make(["x"]).where("doc_id < 0")).count() == 0
    plan = licenses.hits(make(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
