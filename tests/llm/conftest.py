import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(seed: int, n: int) -> str:
    out = []
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append(WORDS[(seed >> 8) % 24] + str((seed >> 16) % 50))
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, nulls, empties, repeated rows, ties, odd white space and a long text."""
    base = sentence(7, 60)
    near = base.split()
    near[30] = "changed"
    out = [
        (1, base, "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, base, "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0),
        (6, " \n\t ", "fr", "s", 3), (7, "one", "fr", "t", 3), (8, "one", "fr", "t", 3), (9, sentence(11, 20) + "\n" + base + "\nTail of it", "de", "t", 9), (None, base, "en", "s", 1),
        (10, sentence(3, 3000), "de", "u", 5), (10, sentence(3, 3000), "de", "u", 5), (11, "Éa ñ x y　z  a\x0bb\n\n\nc", "es", "u", 7), (12, sentence(5, 12), "es", "u", 8), (13, sentence(5, 13), "es", "u", 8),
    ]
    return out + [(100 + i, f"Shared LINE\n{sentence(1000 + i, 8)}\n shared line ", "en", "hot", 1) for i in range(12)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["n_words", "n_hit", "items", "block", "key", "h1", "shard", "score", "kept", "ids", "n_lines", "first", "N_DROPPED", "fingerprint", "lang_pred", "component"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
