import random
import re
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, token string, score string, anchor double, spans int"


def make(spark, rows):
    """documents from (doc_id, text) or (doc_id, text, lang), with further columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", 1, "t", "s", 0.5, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return lambda rows: make(spark, rows)


class Words:
    """Deterministic random text."""

    def __init__(self, seed=0, size=4000):
        self.random = random.Random(seed)
        self.words = ["".join(self.random.choices(string.ascii_lowercase + "éß", k=self.random.randint(2, 9))) for _ in range(size)]

    def text(self, n):
        return " ".join(self.random.choices(self.words, k=n))

    def vary(self, text, share):
        out = [self.random.choice(self.words) if self.random.random() < share else w for w in text.split(" ")]
        return " ".join(out)


@pytest.fixture
def words():
    return Words()


@pytest.fixture(scope="session")
def hostile():
    """Null, empty, blank, short, long, repeated and tied rows."""
    w = Words(7)
    base, passage = w.text(300), w.text(90)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One  two\nTHREE four"), (6, "one two three four"), (7, base), (8, base.upper().replace("É", "é").replace("SS", "ß")), (9, base), (9, base),
        (10, w.vary(base, 0.01)), (11, w.vary(base, 0.02)), (12, w.text(40) + " " + passage + " " + w.text(50)), (13, passage), (14, w.text(10) + "\n" + passage), (15, w.text(60000)),
        (16, "same same " * 3000), (17, "日本語のテキスト " * 60), (18, "é" * 900), (None, w.text(30)), (None, None), (20, w.text(200)), (20, w.text(210)), (21, "\x00\x01 <|endoftext|> 　 x"), (22, "a" * 5000),
        (-5, base), (2**62, w.vary(base, 0.01)),
    ]
    return rows


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
