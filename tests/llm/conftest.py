import pytest
from pyspark.sql import types as T

from watchtide.llm.texts import prepare_texts

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def texts_session(spark):
    return prepare_texts(spark)


@pytest.fixture
def documents(texts_session):
    """Makes a documents table from (id, text) or (id, text, lang, source) rows."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        return texts_session.createDataFrame(full, DOCUMENT)

    return make
