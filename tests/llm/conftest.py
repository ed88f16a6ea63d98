import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [w + e for w in ("alt", "ber", "cor", "dun", "els", "fam", "gir", "hol", "isk", "jun") for e in ("a", "en", "ing", "or", "us", "y")]


def prose(rng, n: int, lines: bool = True) -> str:
    w = [WORDS[i] for i in rng.integers(0, len(WORDS), n)]
    return "".join(x + ("\n" if lines and i % 11 == 10 else " ") for i, x in enumerate(w)).strip()


@pytest.fixture(scope="session")
def texts():
    """Copies, shared passages, periodic text, white space of all kinds, and texts too short for anything."""
    rng = np.random.default_rng(11)
    base = [prose(rng, int(n)) for n in rng.integers(3, 260, 40)]
    shared = prose(rng, 90)
    out = {i: t for i, t in enumerate(base)}
    out |= {100 + i: base[i] for i in (1, 2, 2, 5)} | {200: base[3] + " " + shared, 201: shared + "\n" + base[4], 202: "x " + shared + " y", 203: base[6] + "\t" + shared + "  " + base[7]}
    out |= {300: "ho " * 300, 301: "ab" * 700, 302: "ho " * 45 + "end", 303: "q" * 1500, 304: prose(rng, 4000)}
    out |= {400: None, 401: "", 402: " \n\t ", 403: "one", 404: "one two", 405: "Ünïcödé 日本語 текст 😀 " * 30, 406: "1234 5678 !!", 407: "\x1c  a　b\x85c", 408: "\0 \0"}
    return out


@pytest.fixture()
def docs(spark, texts):
    rows = [(k, t, "en" if k % 3 else "fr", "s0", len(t or "")) for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture()
def odd(spark):
    """Nulls in every column, a repeated row, a null doc_id."""
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", None, "s", 0), (3, "same text here", "en", "s", 1), (3, "same text here", "en", "s", 1), (None, "other words", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
