"""Near copies among repeated and null ids."""

from loomgraph.llm import minhash

BASE = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
THIRD = " ".join(f"third{i}" for i in range(60))


def test_repeated_and_null_ids(spark):
    stay = [(3, BASE), (10, "a text of its own, which only shares the id of a near copy"), (None, "alone"), (None, None), (10, ""), (5, THIRD)]
    go = [(10, BASE + " more"), (None, BASE + " again"), (None, BASE.upper()), (5, THIRD + " more")]
    nobody = [(None, OTHER), (None, OTHER + " more"), (None, OTHER.upper())]
    rows = spark.createDataFrame([(i, t, 1) for i, t in stay + go + nobody], "doc_id long, text string, text_key int").repartition(3)
    left = [(r.doc_id, r.text) for r in minhash.keep_first(rows).collect()]
    key = lambda r: (r[0] or 0, (r[1] or "").lower().replace(" more", ""))
    assert sorted(map(key, left)) == sorted(map(key, [*stay, nobody[0]]))
    assert all(r in left for r in stay if r[0] != 5)
