"""Each registered query of the transit library against its SQL, at the smallest scale."""

import pytest

from fareflow.plans import catalog
from tests.oracle import connection, same

PATH = "/root/testdata/sf0.001"
EMPTY = {"headway_top_stops", "headway_tap_clusters", "headway_cluster_gaps", "headway_bus_line_hour", "headway_bus_mode"}


@pytest.fixture(scope="module")
def con():
    return connection(PATH)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    n = same(catalog.queries()[name](spark, PATH), catalog.oracle_sql()[name], PATH, con)
    assert n > 0 or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, PATH).count() > 0


def test_no_decimals_in_oracles(con):
    for name, sql in catalog.oracle_sql().items():
        kinds = [r[1] for r in con.execute(f"describe {sql}").fetchall()]
        assert not any(k.startswith("DECIMAL") or k == "HUGEINT" for k in kinds), name
