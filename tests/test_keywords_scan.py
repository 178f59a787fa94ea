"""A keyword search by scan keeps the rules of the index."""

from pyspark.sql import functions as F

from quarry.operators import keywords, retrieval

TEXTS = [(1, "", "The a register of Npa norms"), (2, "", "npa only"), (3, "", "internationalisations1 of norms"), (4, "", None), (5, "", "")]


def test_scan_and_index_find_the_same(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "id long, link string, text string")
    index = keywords.KeywordIndex(spark, str(tmp_path / "k"), 2)
    index.update(df, 1)
    tokens = F.split(F.lower("text"), "[^a-z0-9]+")
    for words, expected in ((["NPA norms"], {1}), (["npa", "norms"], {1, 2, 3}), (["a npa"], {1, 2}), (["a"], set()), (["internationalisations1"], set()), (["internationalisations1 norms"], {1, 3}), ([], set())):
        scanned = {r["id"] for r in df.where(retrieval.has_keywords(tokens, words)).collect()}
        assert scanned == expected == {r["id"] for r in index.matching(words).collect()}
