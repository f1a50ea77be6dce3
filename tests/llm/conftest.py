import pytest

#: doc_id, text, lang, source, n_chars: nulls, empties, ties, repeats, odd characters and a long text
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t ", "en", "a", 6),
    (None, "no id here, mail x.y@z.example.com", "en", None, 3),
    (4, "same text twice", "en", "a", 1),
    (4, "same text twice", "en", "a", 1),
    (4, "same id with other text +1 (855) 555-4208", "de", "b", 1),
    (5, "word " * 30_000, "en", "b", 1),
    (6, "7" * 50_000 + " " + "a" * 50_000, "fr", "b", 1),
    (7, "ünïcödé 𝔘 text — a@b.c_x@y.z.w 1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.1", "de", "c", 1),
    (8, "4111 1111 1111 1111 and 4111-1111-1111-1112 <|endoftext|> done", "en", "", 1),
    (9, "under the MIT license; apache license version 2 CC-BY-NC cc by nc cc by nc", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    # an extra column whose name clashes with those the operators make
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({"size": F.lit("clash"), "n_tokens": F.lit("clash"), "_text": F.lit(1), "spans": F.lit(2)})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
