"""Every registered query against its SQL, and the shape of their plans."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracle  # noqa: E402
from decisionlab.plans.registry import QUERIES, SQL  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for step in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert step not in plan
    got = check_oracle.table(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == check_oracle.table(names, result.fetchall())


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 30


def test_scoring_needs_no_shuffle_of_its_own(spark):
    """Row-local scores add no exchange; long ones join the weights by broadcast."""
    from decisionlab import dims
    from decisionlab.operators import scoring
    from decisionlab.plans import bindings as B

    base = B.signal_events(spark, SF)
    scored = scoring.score(base, dims.weights_table(spark))
    exchanges = plan_of(base).count("Exchange hashpartitioning")
    # The weight table, one row per signal name, is gathered in a subquery.
    plan = plan_of(scored)
    own = plan.count("Exchange hashpartitioning(signal#")
    assert plan.count("Exchange hashpartitioning") - own == exchanges
    long = scoring.score(B.events(spark, SF), dims.weights_table(spark), B.signals(spark, SF))
    assert "BroadcastHashJoin [signal" in plan_of(long)


def test_only_needed_columns_are_read(spark):
    from decisionlab.operators import screening
    from decisionlab.plans import bindings as B

    plan = screening.areas(B.events(spark, SF))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
    assert "ReadSchema: struct<o_custkey:bigint>" in plan


def test_entry_without_the_corpus_operators():
    """A dependency of theirs that is not there takes the corpus queries away, and no other."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q; print(len(q))"
    root = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(done.stdout) == len(QUERIES)
