import pytest

#: Nulls, empty and long texts, repeated rows, ties, and columns that clash with the operators' own names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, size long, row string, score double, kept boolean, sources string"
EN = "the river ran over the stones and the children of the village came down to watch the water and the boats"
FR = "la rivière coulait sur les pierres et les enfants du village venaient voir passer les bateaux dans la vallée"
LONG = " ".join(f"{w}{i % 977}" for i in range(4000) for w in ("word", "thing", "stone"))


def rows():
    texts = [
        (1, EN, "en", "a"), (2, EN, "en", "a"), (2, EN, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, FR, "fr", "b"), (6, FR + " demain", "fr", None),
        (7, LONG, "en", "a"), (8, LONG + " end", "en", "c"), (None, EN, None, "c"), (9, "1234 !!", "en", "b"), (10, "x", "en", "b"), (11, "two words", None, "d"), (12, "mail a.b+c@x-y.example.org now", "en", "d"),
    ]
    return [(i, t, g, s, len(t or ""), -1, "h", -2, "r", 0.5, True, "z") for i, t, g, s in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
