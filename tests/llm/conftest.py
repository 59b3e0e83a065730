import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "té", "ru") for b in ("ban", "dor", "fil", "ñu") for c in ("", "s", "a")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(WORDS) + "x"
    return " ".join(words)


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text): prose, copies, near copies, shared passages, odd and empty texts, a repeated row."""
    r = random.Random(7)
    base = [prose(r, r.randrange(60, 200)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        rows += [(100 + 10 * i + k, edited(r, t, k)) for k in range(6)]
    passage = prose(r, 55)
    rows += [(300 + i, f"{prose(r, 40)}\n{passage}\n{prose(r, 40)}") for i in range(25)]
    rows += [(400 + i, edited(r, base[7], 1)) for i in range(40)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "One two"), (504, "one TWO"), (505, "one"), (506, "a b c d"), (507, "long " * 30_000), (508, "x" * 50_000), (509, "é ü 日本 \x01\x02"), (3, base[3])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, f"s{(i or 0) % 5}", "en", len(t or ""), 1, "clash") for i, t in texts] + [(None, "no id here", None, None, None, 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, n_words int, kept string")
