import os

import duckdb
import pytest

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def corner_rows():
    """Nulls, empty and blank texts, ties, repeated rows, copies, a long text, and non-ASCII."""
    base = " ".join(f"w{k}" for k in range(60))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, base), (5, base), (5, base), (None, base), (6, "short text"), (7, "short text"), (8, "One TWO three"), (9, "one two THREE"),
        (10, base.replace("w30", "x30")), (11, "é ü ñ " * 40), (12, "the end\n" * 30), (13, " ".join(f"v{k % 977}" for k in range(30000))), (14, base + " " + base), (None, None), (15, "  \x1c a b"),
        (16, "x" * 5000), (17, "y" * 250), (18, "aab" * 200 + "\n" + "aab" * 90),
    ]


@pytest.fixture(scope="session")
def table_rows(small):
    if not os.path.isdir(small):
        pytest.skip("needs the test tables")
    import pyarrow.parquet as pq

    t = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))
