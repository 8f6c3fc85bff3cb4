"""The registered queries against their SQL, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from saltmarsh.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"



def ordered(rows):
    return sorted(rows, key=lambda r: [repr(x) if not isinstance(x, float) else f"{x:.3g}" for x in r])


def same(a, b):
    """Equal; of numbers rounded by both engines, the last digit may differ where a value lies on its edge."""
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-4))
    return a == b


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = QUERIES[name](spark, DATA)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: ordered([tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in rows])
    ours, theirs = plain(got.select(*names).collect()), plain(found.fetchall())
    assert len(ours) == len(theirs)
    assert not [(a, b) for a, b in zip(ours, theirs) if not all(map(same, a, b))]


def test_every_query_is_documented_by_sql_or_known_to_have_none():
    assert set(QUERIES) - set(ORACLES) == {"speaker_clusters", "clause_stream", "endpoint_stream", "realtime_events", "folded_numerals"}
