"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from conftest import SF, assert_same

from quillspark import catalogue
from quillspark.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert catalogue.FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_only_queries_hold_their_promises(spark):
    assert QUERIES["token_chunks"](spark, SF).where("NOT whole OR longest > 512").count() == 0
    assert QUERIES["protect_restore"](spark, SF).where("NOT whole").count() == 0


def test_no_cartesian_product(spark):
    import contextlib
    import io

    for name in ("rrf_hybrid", "collection_snapshot", "section_of_range", "merge_upsert", "provenance_chain"):
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            QUERIES[name](spark, SF).explain()
        assert "CartesianProduct" not in said.getvalue() and "BroadcastNestedLoopJoin" not in said.getvalue(), name
