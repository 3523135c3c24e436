import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp string, key string"


@pytest.fixture()
def docs(spark):
    """Makes a documents table, with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "d", "f", "k") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture()
def stored(spark, tmp_path, docs):
    """Writes a documents table (and others) and returns its folder."""

    def make(rows, **others):
        docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
        for name, (data, schema) in others.items():
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
