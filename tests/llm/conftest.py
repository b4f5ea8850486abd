import pytest

LINE = "this line is certainly longer than forty characters, as it should be"
SHARED = "A passage of well over fifty bytes that several of the documents have in common, word for word."

#: (doc_id, text, lang, source, n_chars) with every kind of odd row; "node" and "root" clash with inner names.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away\n" + LINE, "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog and runs away\n" + LINE.upper() + "  ", "en", "a", None),
    (2, "the quick brown fox jumps over the lazy dog and runs away\n" + LINE.upper() + "  ", "en", "a", None),
    (3, SHARED + "\n" + LINE, "en", None, 5),
    (4, "Vorher. " + SHARED + " Nachher. " + SHARED + "\n\t " + LINE, "de", "b", 5),
    (5, LINE + "\n" + SHARED[10:], None, "b", 5),
    (6, LINE, "de", "b", 5),
    (7, None, "de", "b", 5),
    (8, "", "fr", "b", 5),
    (9, " \n\t \n", "fr", None, None),
    (10, "été 漢字 😀 <|endoftext|> ▁x  y z", "fr", "c", 3),
    (11, "word " * 3000, "en", "c", 15000),
    (12, "x" * 9000 + SHARED, "en", "c", 9000),
    (13, "one two", "en", "c", 7),
    (14, "One  Two\n", "en", "c", 9),
    (None, "a row without an id: " + SHARED, "en", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, root string, bucket int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "r", 2) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
