import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
#: Names that the operators use inside; as extra columns of an input they must not matter.
CLASHES = ("node", "key", "keys", "n", "r", "u", "p", "s", "d", "g", "score", "label", "block", "length", "its_lang",
           "lang_pred", "piece", "offset", "component_id", "distance", "kept", "salt", "held")

PROSE = ("the quick brown fox jumps over the lazy dog while seven grey owls watch from the old oak tree and wonder "
         "about the noise that the fox makes every night near the river").split()


def prose(n, shift=0):
    return " ".join(PROSE[(i * 7 + shift + i // 29) % len(PROSE)] for i in range(n))


EDGE_ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 5), (4, "x", "de", "b", 1),
    (None, prose(40), "en", "a", 10), (5, prose(40), "en", "a", 10), (5, prose(40), "en", "a", 10),
    (6, prose(41), "en", None, 10), (7, "ünïcode “quotes” 日本語 ​\x00 é", None, "b", 9),
    (8, prose(30_000, 3), "en", "a", 1), (9, "word " * 5000, "en", "a", 1), (10, "nospace" * 20_000, "fr", "a", 1),
    (11, "1234 5678 -- !!", "fr", "c", 3), (12, prose(40), None, "c", 10),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE_ROWS, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
