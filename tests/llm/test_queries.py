"""The queries against their SQL on the smallest tables."""

from types import SimpleNamespace

import duckdb
import pytest

from tracewright.llm.common import shared_dir
from tracewright.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    wanted = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DIR).toPandas()[list(wanted.columns)]

    def rows(df):
        return sorted(repr([round(x, 9) if isinstance(x, float) else x if isinstance(x, (str, bool)) else int(x) for x in r]) for r in df.astype(object).itertuples(index=False))

    assert rows(got) == rows(wanted)


def test_a_cluster_needs_a_shared_folder():
    """Unset, it is a temporary folder on one machine, and an error elsewhere."""

    def session(master: str, folder: str | None = None):
        conf = {"spark.checkpoint.dir": folder} if folder else {}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("spark://x", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[2]")).startswith("file://") and shared_dir(session("local")).startswith("file://")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("local-cluster[2,1,1024]"))
