"""Every query against its SQL, on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__
from tracewright import oracle
from tracewright import queries as engine
from tracewright.operators.ground import match_and_ground
from tracewright.operators.match import find_candidates
from tracewright.sources import lens
from tracewright.sources.library import load_patterns

DIR = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        return round(x, 9) if isinstance(x, float) else x if x is None or isinstance(x, (str, bool)) else None if x != x else int(x)

    return sorted(repr([plain(x) for x in r]) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


# The grounding of every pattern runs its matching too, so the candidate queries are left to the driver's run.
NAMES = sorted(n for n in oracle.ORACLE_SQL if not n.startswith("candidates_") and f"grounding_{n}" not in oracle.ORACLE_SQL)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, name):
    wanted = con.sql(oracle.ORACLE_SQL[name]).df()
    got = engine.QUERIES[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got[list(wanted.columns)]) == rows(wanted)


def test_entry_points(spark):
    assert set(oracle.ORACLE_SQL) <= set(engine.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["pattern_id", "status", "n", "codes"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(plan, table):
    """The columns of the scan of a table."""
    (scan,) = {m[1] for m in re.finditer(r"ReadSchema: struct<([^>]*)>", plan) if any(c.startswith(f"{table}_") for c in m[1].split(","))}
    return {c.split(":")[0] for c in scan.split(",")}


def test_scans_read_only_what_they_need(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = plan_of(engine.QUERIES["storage_changed"](spark, DIR))
    assert columns_read(plan, "l") == {"l_orderkey", *lens.ORDER, *lens.REST}
    assert columns_read(plan, "o") == {"o_orderkey"}  # a trace is an order with lines


NARROW = ["storage_call_kind", "log_decoded_false", "token_transfer_direction", "call_value_flow_out", "net_value_extracted"]


@pytest.mark.parametrize("name", ["flagship", "precision_recall_f1", "reentrancy", "sequence", "ingest_calls", "ingest_nested_calls", *NARROW])
def test_tables_are_read_once_and_traces_built_once(spark, name):
    plan = plan_of(engine.QUERIES[name](spark, DIR))
    assert plan.count("orders.parquet") == 1 and plan.count("lineitem.parquet") == 1
    assert len(re.findall(r"Exchange (?:hash|range|single)", plan)) <= 5


def test_documents_are_read_without_python(spark):
    for name in ("ingest_outcomes", "ingest_call_tracer"):
        assert not re.search("Python|Arrow|InPandas", plan_of(engine.QUERIES[name](spark, DIR)))


def test_matching_needs_no_shuffle(spark):
    """Patterns are matched above the exchange that builds traces, and need none of their own."""
    rows = lens.traces(spark, DIR)
    exchanges = plan_of(rows).count("Exchange")
    assert plan_of(match_and_ground(rows, load_patterns())).count("Exchange") == exchanges
    assert plan_of(find_candidates(rows, load_patterns())).count("Exchange") == exchanges
