"""Queries against their SQL on rows that the given tables do not hold."""

import random

import duckdb
import pytest
from test_queries import ordered, same

from saltmarsh.plans.registry import ORACLES, QUERIES


def differences(spark, folder, name, table, rows, schema):
    """Rows in which the query and its SQL differ over ``rows``, and how many rows the SQL has."""
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"file://{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    ours = ordered([tuple(r) for r in QUERIES[name](spark, f"file://{folder}").select(*names).collect()])
    theirs = ordered(found.fetchall())
    assert len(ours) == len(theirs)
    return [(a, b) for a, b in zip(ours, theirs) if not all(map(same, a, b))], len(theirs)


@pytest.mark.parametrize("sizes", [{"a": 19, "b": 20, None: 40, "c": 1}, {"a": 5000}])
def test_synthesis_efficiency(spark, tmp_path, sizes):
    draw = random.Random(1)
    rows = [(kind, round(draw.expovariate(0.02), 2)) for kind, n in sizes.items() for _ in range(n)]
    rows += [("a", None), ("empty", None)]
    assert differences(spark, tmp_path, "synthesis_efficiency", "events", rows, "event_type string, value double") == ([], len(sizes))


def test_parsed_lines(spark, tmp_path):
    texts = ["1. numbered line\n2) and another", "12、第十二行在这里", "　wide blank　", " no-break ", "- item ", "x item *\u0085", "abc\x0bd\x0c", "a:bcde\nf：ghij", "", None, "** bold **\r\rplain line\r\n· dot ·"]
    draw = random.Random(2)
    signs = list("ab1.)、-·•*「」\"'。？?！!:： \t\n\r\x0b\x1c　 \u0085 中")
    texts += ["".join(draw.choices(signs, weights=[6 if x == "a" else 1 for x in signs], k=draw.randrange(40))) for _ in range(2000)]
    bad, n = differences(spark, tmp_path, "parsed_lines", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert not bad and n > 500
