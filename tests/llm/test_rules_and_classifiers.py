import random
import zlib

import numpy as np
import pytest
from conftest import ODD, prose

from sluice.llm import quality_net, quality_rules, toxicity
from sluice.llm.common import slices


def by_hand(text):
    """The contract's statistics, word by word."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    runs: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        runs.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for places in runs.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_statistics(make):
    r = random.Random(1)
    texts = ODD + [prose(r, n) for n in (9, 10, 40, 300)] + ["a b c d e f a b c d e g h i j", "x\nx\ny\n\nx\n", "| a | b | c |" * 9, "WE SHOUT ALL OF THIS NOW AND FOR EVER MORE"]
    got = {x["doc_id"]: x for x in quality_rules.quality_statistics(make(texts)).collect()}
    for i, t in enumerate(texts):
        wanted = by_hand(t)
        assert tuple(got[i][c] for c in quality_rules.BASE) == wanted, t
        failed = wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    assert [got[i]["kept"] for i in range(len(texts) - 2, len(texts))] == [False, False] and got[len(ODD) + 2]["kept"]


def test_cascade_is_order_free_and_short_circuits():
    r = random.Random(2)
    texts = [t.encode() for t in [prose(r, 50), "| " * 50, "1 2 3 " * 20, "AB " * 30, "a\n" * 20, "w" * 400]]
    rules = quality_rules.METHOD_RULES
    wanted = ~np.logical_or.reduce([x.rejects(quality_rules.Batch(texts)) for x in rules])
    for _ in range(5):
        order = r.sample(rules, len(rules))
        assert (quality_rules._kept(quality_rules.Batch(texts), order) == wanted).all()
    shown = []
    spy = quality_rules.Rule("spy", lambda b: shown.append(len(b.texts)) or np.zeros(len(b.texts), bool))
    quality_rules.cascade(quality_rules.Batch(texts), [rules[0], spy])
    assert shown[0] < len(texts)


def test_order_by_worth():
    a, b, c = (quality_rules.Estimate(n, cost, sel) for n, cost, sel in (("a", 1, 0.5), ("b", 0.1, 0.4), ("c", 0.1, 0.0)))
    rules = [quality_rules.Rule(n, None) for n in "abc"]
    assert [x.name for x in quality_rules.ordered(rules, [a, b, c])] == ["b", "a", "c"]
    assert quality_rules.estimate([b"| | |", b"fine words"], quality_rules.METHOD_RULES[:1])[0].selectivity == 0.5


def test_rules_on_nothing(make, spark):
    empty = make(["x"]).where("doc_id < 0")
    assert quality_rules.quality_statistics(empty).count() == 0
    assert quality_rules.quality_filter(empty).columns == make(["x"]).columns
    kept = quality_rules.quality_filter(make([prose(random.Random(3), 40), "| " * 40, None])).collect()
    assert [x["doc_id"] for x in kept] == [0] and kept[0]["_row"] == "x"


def test_slices():
    texts = [b"a" * 6, None, b"b" * 6, b"c" * 99, b""]
    ranges = list(slices(texts, 10))
    assert [a for a, _ in ranges] == [0, *[b for _, b in ranges[:-1]]] and ranges[-1][1] == 5
    assert all(sum(len(t or b"") for t in texts[a:b]) <= 10 or sum(t is not None and len(t) > 0 for t in texts[a:b]) == 1 for a, b in ranges)


INSULTS = ["grobbel", "snotzak", "vermuffel"]


@pytest.fixture(scope="module")
def marked():
    """Texts, some of them with insults, some of them junk."""
    r = random.Random(4)
    rows = []
    for i in range(900):
        t = prose(r, r.randint(40, 200)).split()
        toxic, bad = int(r.random() < 0.2), int(r.random() < 0.25)
        if bad:
            t = [w + r.choice(["%%%", "&&&", "$$$"]) for w in t]
        if toxic:
            for _ in range(max(2, len(t) // 30)):
                t.insert(r.randrange(len(t)), r.choice(INSULTS))
        rows.append((i, " ".join(t), toxic, 1 - bad))
    return rows


def learnable(i):
    return zlib.crc32(str(i).encode()) % 4 != 2


@pytest.mark.parametrize(("module", "column", "threshold", "least"), [(toxicity, "toxic", 0.3, 0.9), (quality_net, "quality", 0.7, 0.9)])
def test_held_out_accuracy(spark, make, marked, module, column, threshold, least):
    docs = make([m[1] for m in marked] + ODD, list(range(900)) + list(range(10_000, 10_000 + len(ODD))))
    labels = spark.createDataFrame([(m[0], m[3], m[2]) for m in marked] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, labels, per_class=150)
    got = {x["doc_id"]: x for x in module.score(docs, model).collect()}
    assert len(got) == len(marked) + len(ODD)
    right = [int(got[m[0]]["score"] >= threshold) == (m[2] if column == "toxic" else m[3]) for m in marked if not learnable(m[0])]
    assert np.mean(right) >= least
    for i, x in got.items():
        assert x["held_out"] == (not learnable(i)) and 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= threshold)


def test_held_out_labels_have_no_influence(spark, make, marked):
    docs = make([m[1] for m in marked])
    labels = [(m[0], m[3], m[2]) for m in marked]
    flipped = [(i, q, t) if learnable(i) else (i, 1 - q, 1 - t) for i, q, t in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), per_class=150) for x in (labels, flipped))
    assert a.weights is not None and a.parts == b.parts and (a.weights == b.weights).all()


def test_classifiers_without_examples(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality_net):
        model = module.fit(make(["a"]), labels)
        assert {x["score"] for x in module.score(make(ODD), model).collect()} == {0.0}
        assert module.score(make(["x"]).where("doc_id < 0"), model).count() == 0


def test_small_samples_are_learnt_from_too():
    r = random.Random(23)
    rows = []
    for i in range(240):
        t = prose(r, 12).split()
        if i % 2:
            t.insert(r.randrange(len(t)), r.choice(INSULTS))
        rows.append((i, " ".join(t), i % 2))
    model = toxicity.train(rows[:200], 100, 100)
    s = model.scores([t for _, t, _ in rows[200:]])
    assert np.mean((s >= 0.5) == np.array([y for _, _, y in rows[200:]])) >= 0.8
    alike = toxicity.train([(0, "one two", 1), (1, "one two", 0)], 1, 1).scores(["one two", "", "x"])
    assert np.isfinite(alike).all() and abs(alike[0] - 0.5) < 0.3


def test_length_differences_equal_plain_compression():
    import zstandard

    r = random.Random(24)
    shared, toxic, ordinary = (prose(r, 60).encode() for _ in range(3))
    wins = [prose(r, 2).encode() for _ in range(50)] + [b"", b"x" * 500]
    lengths = []
    for head in (ordinary, toxic):
        dictionary = zstandard.ZstdCompressionDict(shared + head, zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(
            window_log=12, chain_log=11, hash_log=11, search_log=3, min_match=4, target_length=16,
            strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        lengths.append([len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress(b" " + w + b" " + shared[-40:])) for w in wins])
    got = toxicity.Compressors(shared, toxic, ordinary).differences(wins)
    assert got.tolist() == [a - b for a, b in zip(*lengths)]


def test_reject_keeps_columns(spark, make, marked):
    docs = make([m[1] for m in marked])
    model = toxicity.fit(docs, spark.createDataFrame([(m[0], m[2]) for m in marked], "doc_id long, toxic int"), per_class=150)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns
    left = {x["doc_id"] for x in kept.collect()}
    assert np.mean([m[0] in left for m in marked if not m[2]]) > 0.95 and np.mean([m[0] in left for m in marked if m[2]]) < 0.1


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 65, 512, 513, 960, 961, 5000):
        text = bytes(1 + i % 250 for i in range(n))
        x, counts = quality_net.chunks([text])
        seen = np.zeros(n, bool)
        stride = quality_net.CHUNK - quality_net.OVERLAP
        for k in range(counts[0]):
            piece = x[k][x[k] > 0]
            assert bytes(piece) == text[k * stride : k * stride + quality_net.CHUNK]
            seen[k * stride : k * stride + len(piece)] = True
        assert seen.all()


def test_gradients():
    r = np.random.default_rng(0)
    net = quality_net.Net(3)
    for n in quality_net.Net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    net.bias += 0.1  # padding sits off the kink at 0
    texts = [bytes(r.integers(97, 110, 700).tolist()), b"short text"]
    y, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])
    _, g = net.gradients(texts, y, weight)
    for name in ("out", "filters", "bias", "shift"):
        p = getattr(net, name)
        at = tuple(r.integers(0, d) for d in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = net.gradients(texts, y, weight)[0]
        p[at] = old - 1e-5
        down = net.gradients(texts, y, weight)[0]
        p[at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3
