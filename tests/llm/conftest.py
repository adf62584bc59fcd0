import pytest


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder of tables made for the edge cases: nulls, empty, blank and long texts, repeated rows, clashing columns."""
    folder = str(tmp_path_factory.mktemp("small"))
    word = "the quick brown fox jumps over a lazy dog while seven wizards brew potent coffee in the old mill".split()
    prose = lambda k, n: " ".join(word[(i * i + k * 7 + i // 5) % len(word)] + str((i * k) % 11 if i % 4 == 0 else "") for i in range(n))
    rows = [(i, prose(i, 60 + i % 40), "en" if i % 3 else "de", f"src{i % 2}", "clash") for i in range(120)]
    copy = rows[5][1]
    rows += [(200, copy, "en", "src0", "x"), (201, copy + " end", "en", "src0", "x"), (202, copy.upper(), None, None, "x"), (203, None, "en", "src1", None), (204, "", "en", "src1", ""), (205, " \n\t", None, "src1", ""), (None, "a text without an id", "en", "src1", ""), (206, prose(3, 30_000), "en", "src0", "long"), (207, "one two", "de", "src0", ""), (207, "one two", "de", "src0", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string")
    frame.selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars", "id", "id AS n", "id AS rep").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, small, tmp_path_factory):
    """The same tables without rows."""
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder
