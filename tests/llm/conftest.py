import pytest

LONG = "la " * 30_000 + "x" * 5_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and clashing column names."""
    rows = [
        (1, "The cat sat on the mat and looked at the moon.\nA second line of some length here.", "en", 7),
        (2, None, "en", 7),
        (3, "", None, 7),
        (4, LONG, "fr", 7),
        (5, "  \n\t \n", "en", 7),
        (6, "the CAT sat on the mat and looked at the moon.\nA second line of some length here.", "en", 7),
        (6, "the CAT sat on the mat and looked at the moon.\nA second line of some length here.", "en", 7),
        (None, "The cat sat on the mat and looked at the moon.\nÉtoile À part", None, 7),
        (8, "<|endoftext|> <|im_end|>\r\n  世界 \U0001f600 don't", "en", 7),
        (9, "...!!! 123 456", None, 7),
    ]
    names = "doc_id bigint, text string, lang string, keep int"
    df = spark.createDataFrame(rows, names)
    for c in ("fp", "key", "norm", "ids", "rid", "root", "n", "score", "h1", "prefix"):
        df = df.withColumn(c, df["keep"])
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
