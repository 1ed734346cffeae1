from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.01"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key string, n int, node string, rid string, kept string"
#: Nulls, empty and odd texts, ties and repeated rows, extra columns with names the operators use inside.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "ONE two three four"), (None, "no id here at all"), (None, None),
    (7, "a" * 5000), (8, "é" * 300 + " Ünïcode \u00a0 x\u2003y"), (9, "same text " * 40), (9, "same text " * 40), (10, "SAME text " * 40), (10, "another text with id ten"),
    (11, "MIT License and the Apache License, GNU General Public License; mit  license"),
    (12, "mail a@b@c.de, x@y.z 10.0.0.300 10.0.0.255 4111 1111 1111 1111 +49 (30) 123456-78 1-2"),
    (13, "<|endoftext|> I'm it's <|startoftext|> ok\r\n\r\n  end "), (14, "7" * 3000), (15, "##\n##\n\n##\nx y z x y z x y z"), (16, "@" * 500 + "a.b" + "." * 50),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None, "s", None, "b", "k", 1, "n", "r", "x") for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
