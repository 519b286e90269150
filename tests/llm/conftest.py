import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sid string, h int, toxic int, passages array<string>, key_ string, line string, quality double, `odd name` int"


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeats, and columns that clash with inner names."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n, seed: " ".join(random.Random(seed).choices(words, k=n))
    base = text(120, 1)
    near = base.split()
    near[60] = "other"
    long_text = text(60_000, 2)
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, None, "de", None), (3, "", None, "b"), (4, " \n\t ", "fr", "a"), (None, text(80, 3), "en", "a"), (None, None, None, None),
        (5, long_text, "en", "b"), (6, base, None, "c"), (7, " ".join(near), "en", "a"), (8, text(90, 5) + " " + " ".join(base.split()[10:80]), "en", "a"), (9, "one", "en", "a"), (10, "Überlänge — ÄÖÜ ñandú 東京 🙂 don't", "de", "a"),
        (11, long_text + " tail", "en", "b"), (12, "ONE", "en", "a"), (13, text(70, 9) + "\n" + text(70, 10), "es", "d"),
    ]
    rng.shuffle(rows)
    full = [(*r, None if r[1] is None else len(r[1]), "x", 1, None, None, "k", "l", 0.5, 7) for r in rows]
    full = [f[:5] + (f[5], f[6], f[7], f[8], f[9], f[10], f[11], f[12]) for f in full]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def base_text(edges):
    return edges.where("doc_id = 6").first().text
