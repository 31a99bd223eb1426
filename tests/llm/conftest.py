import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = prose(1, 6000)
    texts = [
        (1, long, "en", "a", 10), (2, long + " extra", "en", "a", 10), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "  \n ", "de", "b", 4), (6, "one two", "de", "b", 7),
        (7, "one two", "de", "b", 7), (8, "ONE  Two", "de", "b", 8), (9, prose(2, 60), "en", "c", 1), (10, prose(2, 60) + " end", "en", "c", 1), (11, prose(3, 60), "en", "c", 1),
        (11, prose(3, 60), "en", "c", 1), (12, "mail a.b@x.org or A.B@X.ORG, card 4111111111111111, é　日本 😀", "fr", None, 5),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, n string, key string"
    return spark.createDataFrame([(*t, "ids", "n", "k") for t in texts], schema)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
