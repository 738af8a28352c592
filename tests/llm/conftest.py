import pytest

LONG = "Some words that repeat, " * 3000
PASSAGE = "this passage of well over fifty bytes stands in several of the documents here"
ITEM = "which of the seven old rivers of the northern plain runs dry in the second month of summer"


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: nulls, empties, ties, repeated rows, long texts, shared passages."""
    return [
        (7, f"Alpha beta gamma. {PASSAGE}! Delta\n\nepsilon"),
        (1, f"Zeta eta theta {PASSAGE} iota kappa lambda mu nu"),
        (2, None),
        (3, ""),
        (4, LONG),
        (5, LONG),
        (5, LONG),
        (6, "   \t\n "),
        (8, "naïve café — 日本語テキスト " * 40),
        (9, "a"),
        (10, f"before {ITEM} after"),
        (None, f"no id but {PASSAGE}"),
        (-3, "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License, version 3"),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same with columns whose names clash with those used inside."""
    rows = [(i, t, "en", 1, "x", 2.0, 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp long, row string, score double, block int, _id int").coalesce(2)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def folder(tmp_path_factory, spark, docs):
    """A folder of tables as the queries read them."""
    at = tmp_path_factory.mktemp("tables")
    whole = docs.selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) as n_chars")
    whole.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, ITEM), (3, "too short")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (8, 1, None), (10, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)
