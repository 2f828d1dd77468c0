"""op6 and op8 against their SQL, on odd rows."""

import duckdb
import pytest

from loomgraph.llm import minhash, queries, secret_scan

LONG = " ".join(f"word{i}" for i in range(80))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, LONG), (7, LONG.upper()), (7, LONG + " more"),
    (8, LONG.replace("word7 ", "other ")), (9, "é paſſword=abcdefgh PassWord : 'abcdef' token=abc AKIA" + "Z" * 16),
    (10, "AKIA" + "Q" * 12 + "0123456789abcdef01234567 api_key=deadbeefdeadbeefdeadbeef"), (10, "AKIA" + "Q" * 16),
    (11, "🙂 ghp_" + "a" * 36 + " xoxb-" + "1" * 12 + " -----BEGIN RSA PRIVATE KEY-----" + "f" * 24), (None, "alone it stands"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ODD], "doc_id long, text string, s string").repartition(3)


def sql(rows, name):
    documents = rows.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    found = duckdb.connect()
    found.register("documents", documents)
    return found.sql(queries.ORACLES[name])


def same(got, want):
    name = lambda r: tuple(map(str, r))
    return sorted(map(name, got.select(*want.columns).collect())) == sorted(map(name, want.fetchall()))


def test_secrets(rows):
    want = sql(rows, "op6_secret_scan")
    assert sum(r[1] for r in want.fetchall()) == 2
    assert same(secret_scan.find_secrets(rows), sql(rows, "op6_secret_scan"))


def test_near_groups(rows):
    rows = rows.where("doc_id is not null")
    assert same(minhash.near_groups(rows, 3, 85), sql(rows, "op8_minhash"))
