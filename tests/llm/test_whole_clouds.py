"""Clouds of texts just below the similarity must not cost all their pairs, and rows must be found again by content."""

import random

from conftest import prose
from test_dedup import bag, classes

from sluice.llm import near_dedup


def words(r, n):
    return " ".join(prose(r, 2 * n).split()[:n])


def test_a_cloud_below_the_similarity_is_not_verified_pair_by_pair(make, monkeypatch):
    r, looked = random.Random(51), []
    verified = near_dedup._verified

    def counting(pairs, texts):
        looked.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(near_dedup, "_verified", counting)
    common = words(r, 120)
    texts = [f"{common} {words(r, 16)}" for _ in range(240)]
    texts += [f"{texts[k]} {words(r, 2)}" for k in range(0, 40, 10)]  # links within the cloud
    a, b = bag(texts[0]), bag(texts[1])
    assert 0.74 < sum((a & b).values()) / sum((a | b).values()) < 0.8
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts) and len(set(got.values())) == 240
    assert sum(looked) < 8 * len(texts), looked


def test_rows_are_found_by_content_in_any_partitioning(make):
    r = random.Random(52)
    texts = [words(r, 30) for _ in range(30)]
    docs = make(texts + texts[:10] + [None, None, ""], list(range(30)) + list(range(10)) + [1, 1, 1])
    docs = docs.unionAll(docs.where("doc_id = 3"))
    wanted = sorted((x["doc_id"], x["text"]) for x in near_dedup.deduplicate(docs.where("text <> ''")).collect())
    assert wanted == sorted(enumerate(texts))
    assert near_dedup.deduplicate(docs.repartition(7)).count() == 33


def test_signatures_are_kept_only_where_classes_meet(make, monkeypatch):
    r, kept = random.Random(53), []
    written = near_dedup.written

    def seen(df, name):
        out = written(df, name)
        if "sig" in out.columns:
            kept.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", seen)
    common = words(r, 120)
    texts = [words(r, 60) for _ in range(200)] + [f"{common} {words(r, 16)}" for _ in range(60)]
    texts += [f"{texts[k]} {words(r, 2)}" for k in (0, 1, 200, 210)] + texts[:20] + ["", None, "two words"]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicates(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)
    assert 0 < sum(kept) <= 62, kept
