"""A file's number of notices must not cost any of them."""

import math
import random

from conftest import ODD, prose
from test_topk_mixing_licenses import license_words

from sluice.llm import licenses


def test_a_file_of_all_notices_has_all_labels(make):
    r = random.Random(21)
    notices = [text for _, text, _ in licenses.TEMPLATES]
    texts = [f"\n{prose(r, 8)}\n".join(notices)] + [prose(r, 30) for _ in range(20)] + [f"{prose(r, 5)} {n} {prose(r, 5)}" for n in notices]
    every = " ".join(sorted({w for n in notices for w in n.split()}))  # all index words in alphabetical order, then one notice
    texts.append(f"{every} {prose(r, 5)} released under the mit license")
    got = {x["doc_id"]: x for x in licenses.scan(make(texts)).collect()}
    assert {label for label, _, _ in licenses.TEMPLATES} <= set(got[0]["labels"].split(",")) and got[0]["score"] == 1.0
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[21 + i]["labels"].split(",") and got[21 + i]["score"] == 1.0
    assert "mit" in got[len(texts) - 1]["labels"].split(",") and got[len(texts) - 1]["score"] == 1.0


def by_brute_force(texts):
    """Labels that the templates add and the best score, by trying every template at every offset."""
    words = [license_words(t) for t in texts]
    idf = {w: math.log((1 + len(words)) / (1 + sum(w in x for x in words))) for w in licenses.VOCABULARY}
    out = []
    for ws in words:
        labels, score = set(), 0.0
        for label, text, phrase in licenses.TEMPLATES:
            template, key = text.split(), phrase.split()
            rare = sorted(set(template), key=lambda w: (-idf[w], w))[: licenses.INDEX_WORDS]
            at = next(k for k in range(len(template)) if template[k : k + len(key)] == key)
            for o in range(-len(template), len(ws)):
                hit = [0 <= o + k < len(ws) and ws[o + k] == w for k, w in enumerate(template)]
                votes = sum(h for h, w in zip(hit, template) if w in rare)
                if votes >= min(licenses.VOTES, len(template)) and all(hit[at : at + len(key)]):
                    labels.add(label)
                    score = max(score, sum(hit) / len(hit))
        out.append((labels, score))
    return out


def test_added_labels_and_scores_equal_brute_force(make):
    r = random.Random(22)
    notices = [text.split() for _, text, _ in licenses.TEMPLATES]
    texts = list(ODD) + [prose(r, 20) for _ in range(10)]
    for _ in range(120):  # notices with words lost, replaced or doubled, cut short, beside each other
        part = []
        for n in r.choices(notices, k=r.randint(1, 3)):
            n = n[r.choice([0, 0, 1, 3]) :]
            part += [w for x in n for w in ([x], [x], [x], [x], [x], [x], [x], ["zu"], [], [x, x])[r.randrange(10)]] + prose(r, r.randint(0, 3)).split()
        texts.append(" ".join(part))
    wanted = by_brute_force(texts)
    got = {x["doc_id"]: x for x in licenses.scan(make(texts)).collect()}
    for i, (labels, score) in enumerate(wanted):
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == base | labels and abs(got[i]["score"] - score) < 1e-9, texts[i]
    assert sum(bool(x) for x, _ in wanted) > 60


def test_a_very_long_text(make):
    texts = ["all rights x " * 30_000 + "all rights reserved", "licensed under cc by nc 4 0 " * 15_000, "the " * 100_000]
    got = {x["doc_id"]: x for x in licenses.scan(make(texts)).collect()}
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["labels"], got[0]["score"]) == (90_003, 1, "proprietary,reserved", 1.0)
    assert got[1]["n_base"] == 15_000 and got[1]["labels"] == "cc-by,cc-by-nc-4.0" and got[2]["labels"] == ""
