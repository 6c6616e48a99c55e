"""Every registered query of the spatial engine against its SQL, at the smallest scale."""

import duckdb
import pytest

from terravox import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.registry()))
def test_query(spark, con, name):
    got = queries.registry()[name](spark, SF).toPandas()
    if name not in queries.oracles():
        assert len(got.columns) > 0
        return
    want = con.sql(queries.oracles()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        x, y = (a[c].astype(float), b[c].astype(float)) if a[c].dtype.kind in "fiu" else (a[c], b[c])
        assert ((x == y) | (x.isna() & y.isna())).all(), c


def _on(spark, folder, name, **tables):
    """Rows of a query and of its SQL, as texts, over tables that are given as SQL."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got, want = queries.registry()[name](spark, str(folder)).toPandas(), c.sql(queries.oracles()[name]).df()
    return tuple(sorted(map(str, x[sorted(want.columns)].astype(float).to_numpy().tolist())) for x in (got, want))


#: Every cell has as many rows, so none stands out and cells3 is zero throughout.
EVEN = """SELECT (iz + 1)::INTEGER AS l_linenumber, (ix + 1)::DOUBLE AS l_quantity, iy / 100.0::DOUBLE AS l_discount, 100.0::DOUBLE + ix AS l_extendedprice
    FROM (SELECT unnest(range(50)) AS ix), (SELECT unnest(range(11)) AS iy), (SELECT unnest(range(7)) AS iz)"""


def test_centroid_of_a_grid_of_zeros(spark, tmp_path):
    got, want = _on(spark, tmp_path, "grid_centroid", lineitem=EVEN)
    assert got == want == ["[nan, nan, nan, 1.0]"]


def test_quotients_by_zero(spark):
    from pyspark.sql import functions as F

    from terravox.operators.grid import quotient

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(((1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None)))], "i int, a double, b double")
    got = [str(r.v) for r in rows.select("i", quotient(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == ["inf", "-inf", "nan", "1.5", "None", "None"]


def test_normalize_a_grid_of_zeros(spark, tmp_path):
    got, want = _on(spark, tmp_path, "grid_normalize", lineitem=EVEN)
    assert got == want and len(got) == 3850 and all("nan" in r for r in got)


def test_days_of_a_scan_grid_by_rounded_seconds(spark, tmp_path):
    """The last half second of a day, halves, and days before 1970."""
    times = ["2024-01-01 23:59:59.4", "2024-01-01 23:59:59.5", "2024-01-01 23:59:59.7", "2024-01-02 00:00:00", "1969-12-31 23:59:59.7", "1969-12-31 12:00:00", "1969-12-30 23:59:59.2", "1969-12-30 00:00:00.5"]
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', {i}, 'click', {i}.5)" for i, t in enumerate(times))
    events = f"SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value) UNION ALL SELECT 99, NULL, 99, 'view', 1"
    got, want = _on(spark, tmp_path, "scan_grid", events=events)
    assert got == want and len(got) == 9
