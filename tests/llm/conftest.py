import pytest
from pyspark.sql import Row


@pytest.fixture
def table(spark):
    """Documents from texts, with a column whose name the operators might use themselves."""

    def make(texts, **more):
        rows = [Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or ""), score=0.5,
                    **{k: v[i] for k, v in more.items()}) for i, t in enumerate(texts)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
        schema += "".join(f", {k} string" for k in more)
        return spark.createDataFrame(rows, schema)

    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
