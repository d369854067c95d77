import random

import pytest

SYLLABLES = "an be co du el fi go ha in jo ka lu me no or pa qui ra so ti un ve wo ya zu".split()


def prose(r: random.Random, n: int) -> str:
    """Invented words, some sentences."""
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) + (". " if r.random() < 0.1 else "").strip() for _ in range(n))


def edited(r: random.Random, text: str, share: float) -> str:
    return " ".join(prose(r, 1) if r.random() < share else w for w in text.split(" "))


#: Texts that every operator has to take: nulls, nothing, blanks, odd characters, repeated and very long ones.
ODD = [
    None, "", " ", "\n\t\x0b", "a", "one two", "ümläut ▁ 日本語 \U0001f600 é", "x" * 5000, "ha " * 3000, "same text here", "same text here", "\x00 \x1c nul",
    "  two  spaces ", "K K",
]


@pytest.fixture()
def make(spark):
    """Documents with a column of each name that the operators use inside, to clash with theirs."""

    def build(texts, ids=None, sources=None, **extra):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        sources = [f"s{i % 3}" for i in range(n)] if sources is None else sources
        rows = [(i, t, "en", s, None if t is None else len(t), "x", 7, 1.5) for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string, score int, size double").repartition(3)

    return build
