import pytest

PASSAGE = " ".join(f"shared{i}" for i in range(60))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows and ids."""
    long = " ".join(f"w{i * i % 977}" for i in range(9000))
    near = " ".join(f"near{i}" for i in range(400))
    return [
        (1, "The quick brown fox jumps over the lazy dog. " * 4), (2, "THE quick brown fox jumps over the lazy dog. " * 4),
        (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, long), (8, long + " end"), (9, f"start of nine {PASSAGE} end of nine"),
        (10, f"ten begins {PASSAGE}\n{PASSAGE} and ends"), (11, near), (12, near + " tail"), (13, "日本語のテキスト ünïcode ÄÖÜ " * 9), (14, "a" * 400),
        (15, "a b c d e " * 60), (15, "a b c d e " * 60), (16, "same id, one"), (16, "same id, two"), (None, "The quick brown fox jumps over the lazy dog. " * 4),
        (17, "x\x00y # $ % & | < > *\nline\nline\n\nline\r\n"), (18, "The quick brown fox jumps over the lazy dog. " * 4),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with more columns, some with names that operators use themselves."""
    rows = [(d, t, "en", 1, 0.5, "k") for d, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block int, score double, _text string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(d, d % 2, 0) for d, _ in odd_rows if d] + [(None, 1, 0), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
