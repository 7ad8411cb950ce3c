import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "ly"]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(k, text(k, 30 + k), "en", "a" if k % 3 else "b", k, k, "x") for k in range(40)]
    rows += [(100, None, None, None, None, None, None), (101, "", "de", "a", 0, 0, "y"), (102, " \n\t ", None, "a", 3, 1, "z"), (103, text(7, 20000), "en", "a", 1, 1, "w"), (None, text(3, 33), "en", None, 1, 1, "q")]
    rows += [(200 + k, text(5, 35), "en", "a", 1, 1, "c") for k in range(5)] + [(7, text(7, 37), "en", "a", 7, 7, "x")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long, kept string").repartition(3)
