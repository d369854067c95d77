"""An identifier that is known is found wherever it stands."""

import random
import time

from conftest import prose
from test_pii_pieces_pipeline import brute

from sluice.llm import pii


def test_known_identifiers_without_context(make):
    r = random.Random(41)
    texts = [f"{prose(r, 5)} token = \"{''.join(r.choices('0123456789abcdef', k=40))}\" {prose(r, 5)}" for _ in range(30)]
    name = "pk-88x-123456-zz"
    texts += [f"{prose(r, 5)} token = \"{name}\" {prose(r, 4)}", f"{name} {prose(r, 4)}", f"(({name})) {prose(r, 4)}", name, f"2024-0001-77 {prose(r, 4)}"]
    docs = make(texts)
    got = {x["doc_id"]: x["spans"] for x in pii.find(docs).collect()}
    assert [got[i] for i in range(31, 35)] == ["secret:0:16", "secret:2:18", "secret:0:16", ""]
    out = {x["doc_id"]: x["text"] for x in pii.redact(docs).collect()}
    assert not any(name in out[i] for i in range(30, 34)) and out[34] == texts[34]


def test_long_runs_cost_their_length():
    began = time.perf_counter()
    for text in ("a" * 1_000_000, "a." * 300_000 + "@", "1" * 1_000_000, "1." * 300_000, "+1(" * 300_000, "a@b" * 200_000, "1.2.3.4 " * 100_000):
        pii.candidates(text, pii.base_spans(text))
    assert time.perf_counter() - began < 60


def test_emails_and_addresses_equal_the_patterns():
    r = random.Random(42)
    for _ in range(3000):
        text = "".join(r.choices("ab@.-1 _é", [3, 2, 3, 3, 1, 2, 1, 1, 1], k=40))
        assert pii.base_spans(text) == brute(text), text
        digits = "".join(r.choices("12.5 x", [3, 2, 4, 1, 1, 1], k=40))
        assert pii.base_spans(digits) == brute(digits), digits


def test_number_of_spans_and_clashing_names(make):
    docs = make(["mail me@host.example.org or 10.0.0.1", "nothing", None])
    got = {x["doc_id"]: (x["n_spans"], x["n_email"], x["n_ip"]) for x in pii.find(docs).collect()}
    assert got == {0: (2, 1, 1), 1: (0, 0, 0), 2: (0, 0, 0)}
    odd = docs.withColumnRenamed("lang", "_pii_key").withColumnRenamed("source", "_pii_more")
    out = pii.redact(odd)
    assert out.columns == odd.columns and {x["text"] for x in out.collect()} == {"mail <EMAIL> or <IP>", "nothing", None}
