import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
EXTRA = ("digest", "keep_id", "group_size", "kept", "node", "size", "label", "score", "rank", "n",
         "mark", "k", "d", "h", "salt", "block", "weight", "tokens", "rep")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
EDGES = [
    (1, None, "en", "s", None),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "s", 4),
    (4, "one two", "en", "s", 7),
    (5, "one two", "fr", "s", 7),
    (5, "one two", "fr", "s", 7),
    (None, "one two", None, None, None),
    (None, None, None, None, None),
    (7, "12345 678", "en", "s", 9),
    (8, LONG, "en", "s", len(LONG)),
    (9, LONG + " tail", "en", "s", len(LONG) + 5),
    (9, "another text for number nine", "en", "s", 28),
]


@pytest.fixture
def edges(spark):
    """Documents with nulls, empty and long texts, repeats, and clashing further columns."""
    docs = spark.createDataFrame(EDGES, SCHEMA)
    return docs.selectExpr("*", *[f"'x' as {name}" for name in EXTRA])


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    """Rows of a table at the smallest scale."""
    con = duckdb.connect()

    def read(sql, sf=SF):
        for name in ("documents", "pages", "benchmark", "labels", "events"):
            con.execute(f"create or replace view {name} as select * from '{sf}/{name}.parquet'")
        return con.execute(sql).fetchall()

    return read
