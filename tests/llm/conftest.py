"""Documents with every odd case the operators have to take."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label int, word string, row long, keep_id long"


def odd_rows():
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "the", "of", "and", "x1", "rock", "stone", "river", "moon"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    base = [text(r.randint(60, 120)) for _ in range(12)]
    out = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "one two"), (5, "!!! ???"), (6, "é" * 5000 + " long " + text(3000))]
    out += [(10 + i, b) for i, b in enumerate(base)]
    out += [(40 + i, b) for i, b in enumerate(base[:5])]  # copies
    for i, b in enumerate(base[:8]):  # near copies
        w = b.split()
        w[len(w) // 2] = "changed"
        out.append((60 + i, " ".join(w)))
    out += [(90, base[0].upper()), (91, "a\rb\x0bc d e <|endoftext|> 'tis  two   three\n\n\nend "), (10, base[0]), (10, "repeated id, other text")]
    return out


@pytest.fixture(scope="session")
def odd():
    return odd_rows()


@pytest.fixture(scope="session")
def docs(spark, odd):
    rows = [(i, t, None, "s", None, 7, "clash", -1, -2) for i, t in odd] + [(None, "no id at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
