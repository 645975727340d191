import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    long = "\n".join(f"line {i} of a very long text with words {i % 7} and more, and more." for i in range(3000))
    rows = [
        (1, "", "en", "a", 0), (2, None, "en", "a", None), (None, "no id here, but some words to read.", None, None, 5), (3, " \n\t ", "de", "b", 4),
        (4, long, "en", "c", len(long)), (5, "same text here for all of us now", "en", "d", 5), (6, "same text here for all of us now", "en", "d", 5),
        (6, "same text here for all of us now", "en", "d", 5), (7, "12345 !!! 678", "fr", "e", 3), (8, "été où ça 中文    end", None, "f", 3),
        (9, "first of two", "en", "g", 1), (9, "second of two", "en", "g", 1), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCUMENT)
    clash = {n: df["source"] for n in ("shard", "slot", "key", "score", "labels", "print", "node", "ids", "curve", "_row", "_removed", "_doc_id", "n_lines", "votes", "kept", "want", "_score")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)
