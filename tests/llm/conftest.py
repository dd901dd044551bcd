import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    passage = "this shared passage is long enough to count as boilerplate on many different sites of the web"
    body = "\n".join(f"line number {i} of a very long text with words w{i} and v{i % 7}" for i in range(4000))
    rows = [(1, "first own line of the first document here\n" + passage, "en", "a", 10, 1, "x"),
            (2, "second own line of the second document here\n" + passage, "en", "b", 10, 2, "x"),
            (3, "third own line of the third document here\n" + passage, "de", "c", 10, 3, "x"),
            (3, "third own line of the third document here\n" + passage, "de", "c", 10, 3, "x"),
            (4, None, "en", "a", None, None, None), (5, "", None, None, 0, 5, None), (6, " \t\n\x0b", "en", None, 4, 6, None),
            (None, "a text whose id is null\n" + passage, None, "d", 9, 7, "x"), (7, body, "en", "a", len(body), 8, "x"),
            (8, "mail jo.doe@example.com or JO.DOE@EXAMPLE.COM", "en", "b", 30, 9, "x"), (9, "üİ PASSWORD = hunter2hunter2", "en", "b", 30, 9, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `class` long, score string")
