import hashlib
import os
import random
import re

import pytest
from conftest import ODD, prose

from sluice.llm import pii

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def brute(text):
    """The base spans by one regular expression after the other, checked digit by digit."""
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if max(map(int, m.group().split("."))) <= 255:
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


CASES = [
    "a.b@c.example.com, x@y z@w.v 1.2.3.4 256.1.1.1 1.2.3.4.5 010.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713 +44 20 7946 0958.",
    "++1 234 567 8901 (+12) 345678901234567890", "é@x.y ü 4111111111111111é", "12345678901234567890 " * 3,
]


def secrets(r):
    return "".join(r.choices("0123456789abcdef", k=40))


def test_base_spans():
    r = random.Random(13)
    for _ in range(400):
        text = "".join(r.choices("0123456789.+-() @ab", k=60))
        assert pii.base_spans(text) == brute(text)
    for t in CASES + [x or "" for x in ODD]:
        assert pii.base_spans(t) == brute(t)


def test_find(make):
    r = random.Random(14)
    texts = CASES + ODD + [f"{prose(r, 5)} token = \"{secrets(r)}\" {prose(r, 5)}" for _ in range(30)]
    texts += [f"{prose(r, 5)} token = \"pk-88x-{r.randrange(10**6)}-zz\" {prose(r, 4)}", f"{prose(r, 5)} order 2024-0001-77 {prose(r, 4)}"]
    got = {x["doc_id"]: x for x in pii.find(make(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base, x = brute(t), got[i]
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [x[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in x["spans"].split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    found = got[len(texts) - 2]["spans"]  # an identifier of a new form, by its context alone
    assert found.startswith("secret:") and not got[len(texts) - 1]["spans"]


def test_patterns_need_support_and_confidence(make):
    r = random.Random(15)
    few = [f"{prose(r, 3)} key = {secrets(r)} x" for _ in range(3)] + ["see key = pk-88x-123456-zz x"]
    assert pii.find(make(few)).where("spans <> ''").count() == 0
    mixed = [f"{prose(r, 3)} key = {secrets(r)} x" for _ in range(12)] + [f"{prose(r, 3)} key = order-{i}-2024-x x" for i in range(12)]
    assert pii.find(make(mixed)).where("spans <> ''").count() == 0


def test_redact(make):
    r = random.Random(16)
    texts = CASES + ODD + [f"{prose(r, 5)} token = \"{secrets(r)}\" tail" for _ in range(20)]
    docs = make(texts)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {x["doc_id"]: x for x in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["text"] is None) == (t is None) and x["n_chars"] == (None if t is None else len(x["text"])) and not (t is not None and brute(x["text"]))
        if t is not None and not brute(t) and "token" not in t:
            assert x["text"] == t
    assert all("<SECRET>" in got[len(CASES) + len(ODD) + i]["text"] for i in range(20))
    assert pii.redact(docs.where("doc_id < 0")).count() == 0 and pii.find(docs.where("doc_id < 0")).count() == 0


# -- pieces ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(MODEL):
        pytest.skip("no tokenizer files")
    from sluice.llm.sentencepiece_lattice import Vocabulary

    return Vocabulary.load(MODEL)


def piece_texts():
    r = random.Random(17)
    chars = "abcdeéß12 .,!-_▁²   \n\t日本ñ"
    return ODD + [prose(r, 80) for _ in range(20)] + ["".join(r.choices(chars, k=r.randint(1, 90))) for _ in range(150)] + [" " * n for n in (1, 2, 15, 16, 17, 33, 70)] + ["!" * 100, "Hello, World! (don't) 3.14"]


@pytest.mark.parametrize("cached", [1 << 20, 40, 1])
def test_bpe_ids_equal_the_librarys(make, vocabulary, cached):
    from sluice.llm.sentencepiece_lattice import decoded, encode

    texts = piece_texts()
    out = encode(make(texts), vocabulary, cached)
    got = {x["doc_id"]: x for x in decoded(out, vocabulary).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == vocabulary.library.encode(t or ""), repr(t)
        assert got[i]["round_trip"] and got[i]["n_tokens"] == len(got[i]["ids"])
        assert got[i]["text"] == (t or "").replace("▁", " ")


def test_viterbi_paths_score_as_the_librarys(make, vocabulary):
    """The same pieces as a unigram model: the library then takes the best path too, and ids differ in ties alone."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    from sluice.llm.sentencepiece_lattice import Vocabulary, encode

    m = proto.ModelProto()
    m.ParseFromString(vocabulary.model)
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    r = random.Random(18)
    for p in m.pieces:
        if p.type == proto.ModelProto.SentencePiece.NORMAL:
            p.score = -2.0 - 1.5 * len(p.piece) ** 0.5 - r.random()
    unigram = Vocabulary(m.SerializeToString())
    assert not unigram.is_bpe
    texts = [t for t in piece_texts() if t is None or len(t) < 2000]
    got = {x["doc_id"]: x["ids"] for x in encode(make(texts), unigram, 50).collect()}
    score = {i: s for i, s in unigram.pieces.values()}
    same = 0
    for i, t in enumerate(texts):
        wanted = unigram.library.encode(t or "")
        same += got[i] == wanted
        assert unigram.library.decode(got[i]) == unigram.library.decode(wanted)
        assert abs(sum(score.get(x, -50) for x in got[i]) - sum(score.get(x, -50) for x in wanted)) < 1e-2, repr(t)
    assert same > 0.9 * len(texts)


def test_pieces_of_nothing_and_repeated_rows(make, vocabulary):
    from sluice.llm.sentencepiece_lattice import encode

    docs = make(["one two", "one two", "x"], [1, 1, 2])
    assert encode(docs.where("doc_id < 0"), vocabulary).count() == 0
    assert sorted(x["doc_id"] for x in encode(docs.unionAll(docs), vocabulary, 1).collect()) == [1, 1, 1, 1, 2, 2]


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, make, vocabulary, tmp_path):
    import corpus_pipeline

    r = random.Random(19)
    texts, labels = [], []
    for i in range(400):
        t = prose(r, 60).split()
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            t.insert(r.randrange(len(t)), r.choice(["grobbel", "snotzak"]))
        texts.append(" ".join(t))
        labels.append((i, 1, toxic))
    texts += [texts[1]] * 5 + [texts[2] + " tail"] + [prose(r, 30) + " mail me@host.example.org " + prose(r, 30)] + ODD
    docs = make(texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(f"{tmp_path}/stage{k}")
        d = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(d)
    assert all(x.columns == docs.columns for x in seen[:4])
    ids = [{x["doc_id"] for x in s.collect()} for s in seen]
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & ids[0]) < 0.1 * len(toxic) and len(set(range(400)) - toxic - ids[0]) < 20
    assert len(ids[1] & {1, *range(400, 405)}) == 1 and len(ids[1] & {2, 405}) == 1
    assert seen[2].where("text LIKE '%me@host%'").count() == 0 and seen[2].where("text LIKE '%<EMAIL>%'").count() == 1
    assert ids[2] == ids[1] and ids[3] <= ids[2]
    for x in seen[4].join(seen[3].select("doc_id", "text").distinct(), "doc_id").collect():
        assert x["round_trip"] and vocabulary.library.encode(x["text"] or "") == x["ids"]
    assert sorted(x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(x["doc_id"] for x in seen[4].collect())
