import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def words():
    import random

    def make(seed, n):
        r = random.Random(seed)
        return [r.choice(WORDS) + str(r.randrange(40)) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """rows: (doc_id, text[, source, lang]) -> documents with a clashing extra column."""

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "extra") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h string")

    return make


#: Null, empty, blank, short, repeated and long texts, null and repeated ids.
@pytest.fixture(scope="session")
def odd(words):
    long = " ".join(words(99, 30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "ONE two three four"), (7, "é ﬁ ① 中文 \x00"), (8, long), (8, long), (None, "null id text with several words"), (9, "a\n\nb\n"), (10, "same same same same same same same same same same same same")]
