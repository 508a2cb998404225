from spanweave.operators.stats import rank_documents


def test_documents_without_the_terms_are_ranked(spark):
    """They have score 0, before documents in which the term is rarer than elsewhere."""
    rows = [("a", 1, 5), ("b", 1, 1), ("a", 2, 1), ("b", 2, 50), ("b", 3, 5), ("c", 4, 1)]
    got = [(r.y, r.score) for r in rank_documents(spark.createDataFrame(rows, "x string, y long, n long"), ["a"]).collect()]
    assert [y for y, _ in got] == [1, 3, 4, 2]
    assert got[0][1] > 0 == got[1][1] == got[2][1] > got[3][1]
