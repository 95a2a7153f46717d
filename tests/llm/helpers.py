"""Rows that every operator must take: nulls, empty, long, tied and repeated ones, extra columns."""

LONG = "lorem ipsum dolor sit amet consectetur " * 6000

ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", 7, 0.5),
    (2, None, None, None, None),
    (3, "", "en", 1, 0.1),
    (4, " \n\t ", "en", 1, 0.1),
    (5, "the quick brown fox jumps over the lazy dog and runs away", "en", 7, 0.5),
    (6, LONG, "xx", 9, 0.2),
    (7, "one", "de", None, None),
    (8, "漢字かな交じり文 ▁ \U0001f600 é", "ja", 3, 0.3),
    (9, "a" * 5000, "en", 3, 0.3),
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", 7, 0.5),
]
#: Extra columns carry names that operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, score int, rank double"


def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
