import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "tion"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, odd white space, empty, null and very long ones."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    passage = prose(rng, 70)
    out = [*base, base[0], base[0], base[3] + " end", "", None, "   \t\n", "one", "two words", "Ünïcode Wörter é\x0b tab\tnew\nline", "a" * 3000, prose(rng, 6000)]
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 30)}" for _ in range(6)]
    out += [passage.replace(" ", "\n"), passage + " " + passage]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with a null id, a repeated row and columns whose names clash with results'."""
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "no id at all", "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, shard int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
