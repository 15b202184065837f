import random

import pytest

WORDS = "the sea is calm and a ship sails north under stars while gulls cry over cold water near old stone piers where nets dry in wind".split()
CLASH = "kept string, keep_id string, size string, row string, fp string, batch string, part string, draw string, shard string, _m string, tie string, at string, text_sha256 string, n string, ids string, level string"


def prose(r: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.5 else ""))
        if k % 11 == 10:
            out[-1] += r.choice([".", ".\n", ",", "!"])
    return " ".join(out)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source): copies, near copies, nulls, empty and white texts, repeated rows, ties, odd characters, one long text."""
    r = random.Random(5)
    base = [prose(r, r.choice([1, 2, 5, 60, 120, 300])) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 60):
        rows.append((i, base[i - 40]))  # copies
    for i in range(60, 75):
        w = base[i - 60].split(" ")
        w[len(w) // 2] = "CHANGED"
        rows.append((i, " ".join(w)))
    hot = prose(r, 80)
    rows += [(i, hot) for i in range(75, 110)]  # a third of all rows
    rows += [(110, None), (111, ""), (112, " \n\t "), (113, "\x0b\x0c\r"), (114, "x"), (115, "aaaa" * 200), (116, "ab " * 400), (117, "é€😀 Σς ß İ \x1c <|endoftext|> \x01 '"), (118, hot.replace(" ", "  "))]
    rows += [(119, prose(r, 20_000)), (5, base[5]), (5, base[5]), (None, base[3]), (None, None), (7, "another text under the same id " * 9)]
    return [(i, t, ["en", "fr", None][k % 3], ["a", "a", "b", None][k % 4]) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    clash = ["x"] * len(CLASH.split(", "))
    df = spark.createDataFrame([(*t, *clash) for t in texts], f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)
    return df.persist()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
