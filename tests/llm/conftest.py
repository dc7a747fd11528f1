import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id int, component string, start int"


def _row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), "clash", 1, "clash", 2)


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, shared lines and passages."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = " ".join(words(60))
    line = "A line that many documents share, word for word."
    out = []
    for _ in range(60):
        w = words(rng.randint(1, 160))
        lines = [" ".join(w[k : k + 30]) for k in range(0, len(w), 30)]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), line)
        if rng.random() < 0.2:
            lines[0] += " " + passage + " " + " ".join(words(5))
        out.append("\n".join(lines))
    for _ in range(12):
        out.append(out[rng.randrange(20)])
    for _ in range(20):
        w = out[rng.randrange(40)].split(" ")
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="session")
def documents(spark, prose):
    langs, sources = ["en", "de", "fr", None], ["s0", "s0", "s0", "s1", "s2", None]
    rows = [_row(i, t, langs[i % 4], sources[i % 6]) for i, t in enumerate(prose)]
    rows += [
        _row(200, None),
        _row(201, ""),
        _row(202, " \t\n\x0b\f\r "),
        _row(203, "One"),
        _row(203, "One"),  # a repeated row
        _row(204, prose[0].upper()),
        _row(205, prose[0].replace(" ", "  ")),
        _row(None, prose[1], None, None),
        _row(206, "x" * 70_000 + " " + "y z " * 20_000),  # long
        _row(207, "é ß 中文 😀 \x00 \x1f  "),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
