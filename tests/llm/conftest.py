import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n, seed=0):
    """n words that repeat no five-word window for small n."""
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"{WORDS[(x >> 8) % 24]}{WORDS[(x >> 14) % 24]}{(x >> 20) % 7}")
    return " ".join(out)


def odd_rows():
    """Nulls in any column, empty and blank and very long texts, ties, repeated rows."""
    rows = [
        (1, prose(60, 1), "en", "a", 10), (2, prose(60, 2), "en", "b", 10), (2, prose(60, 2), "en", "b", 10), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (None, prose(30, 3), "en", "b", 5), (None, None, None, None, None), (6, prose(20_000, 4), "de", "a", 1), (7, prose(60, 1), "en", "a", 10), (7, prose(40, 9), "fr", "c", 10), (8, "é ü 日本語 " * 3, "fr", "c", 9), (9, "x" * 5000, "en", "c", 5000),
    ]
    return rows


@pytest.fixture
def odd(spark):
    """odd_rows with columns whose names the operators might use themselves."""
    df = spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)
    from pyspark.sql import functions as F

    for name in ("fp", "label", "base", "pii", "copy", "shuffle_key", "toxicity", "host", "th", "key", "n", "id", "rank", "task", "words", "start", "line"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], COLUMNS)
