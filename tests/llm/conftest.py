import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "\n\n  x\t", "a", "Don't STOP  now  é́ 　x", "naïve İstanbul ΣΑΣ 123 4.5 <|endoftext|>", "☃\U0001f600" * 5, "x" * 5000, "the MIT License, the mit\nlicense and CC-BY", " GNU General Public License v3. Apache License"]


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, odd, long and repeated texts, repeated and null ids, and columns with clashing names."""
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(ODD)] + [(3, ODD[6], "en", "s", 0), (3, ODD[6], "en", "s", 0), (None, "null id", None, None, None)]
    return spark.createDataFrame([r + (1, "x", 2) for r in rows], SCHEMA + ", __rid int, part string, score int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rng():
    return random.Random(7)
