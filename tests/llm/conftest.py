import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text):
    return WORD.findall((text or "").translate(ASCII))


@pytest.fixture(scope="session")
def texts(spark):
    """doc_id -> text of the smallest table."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# Nulls, empty and long texts, repeated rows, ties, and clashing extra columns.
ODD_SCHEMA = ("doc_id long, text string, lang string, words int, score double, key string, label int, n long, "
              "line int, _id long, node binary, bands int, hot string, row string")


@pytest.fixture(scope="session")
def odd_docs(spark):
    long_text = " ".join(f"word{i % 977} plain{i % 31}" for i in range(30000))
    prose = "The quick brown fox jumps over the lazy dog while the band plays on.\nSecond line of plain words here."
    rows = [(1, prose), (1, prose), (2, prose), (3, None), (None, None), (None, prose), (4, ""), (5, " \n\t\n "),
            (6, "!!! ... ???"), (7, "one"), (8, long_text), (9, "Ünïcode wörter über alles, 日本語 テキスト."),
            (9, "Another text with the same id as its neighbour, five words or more."),
            (10, "a   b \n c  <|endoftext|> d\r\n\r\nx \t y ")]
    return spark.createDataFrame([(i, t, "en", 1, 0.5, "k", 1, 2, 3, 4, b"x", 5, "h", "r") for i, t in rows],
                                 ODD_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (8, 0, 1), (9, 1, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int")
