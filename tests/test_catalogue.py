"""Every query of the catalogue against its SQL in DuckDB, over whole tables."""

import decimal

import duckdb
import pytest

from weft.catalogue import CATALOGUE, queries
from weft.plans.language import STEPS, PREDICATES, tokens

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    return [plain(y) for y in x] if isinstance(x, list) else round(x, 9) if isinstance(x, float) else float(x) if isinstance(x, decimal.Decimal) else x


@pytest.mark.parametrize("name", CATALOGUE)
def test_against_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    found = duck.execute(CATALOGUE[name][1])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    want = [tuple(map(plain, r)) for r in found.fetchall()]
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str) == sorted(want, key=str)


def test_every_step_and_predicate_has_a_query():
    used = {t for text, _ in CATALOGUE.values() for k, t in tokens(text) if k == "name"}
    assert STEPS <= used and PREDICATES <= used
