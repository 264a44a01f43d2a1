import os
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
os.environ.setdefault("OMP_NUM_THREADS", "1")  # numpy: one thread per Spark task
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.local.dir", str(root / "local"))
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Compare a Spark result with a DuckDB query over a folder of tables."""
    import duckdb

    def plain(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        if isinstance(x, (list, tuple)):
            return str([plain(y) for y in x])
        if isinstance(x, bool) or x is None:
            return str(x)
        return str(x)

    def check(spark_df, sql, sf_dir):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = cur.fetchall()
        assert sorted(spark_df.columns) == sorted(names)
        order = sorted(names)
        got = sorted([plain(r[c]) for c in order] for r in spark_df.collect())
        want = sorted([plain(r[names.index(c)]) for c in order] for r in want)
        assert len(got) == len(want), (len(got), len(want))
        bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
        assert not bad, (len(bad), bad[:3])

    return check
