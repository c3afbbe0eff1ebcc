import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing", "é"]) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture
def documents(spark):
    """A DataFrame of documents from (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""

    def make(rows):
        clash = "body string, h1 string, c string, n string, k string, score string, rate string, gone string, sig string, digest string, ids string"
        extra = ["x"] * 11
        data = [(i, t, "en", "s", None if t is None else len(t), *extra) for i, t in rows]
        return spark.createDataFrame(data, f"{DOCS}, {clash}").repartition(3)

    return make
