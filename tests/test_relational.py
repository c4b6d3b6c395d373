import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from granary.functions.dialect import int_avg, int_div, strict_and, strict_or
from granary.operators import changes, relational as rel
from granary.operators.snapshots import ConflictError, VersionedTables
from granary.plans import core
from granary.sources import catalog
from granary.sources.parquet import TABLES, ranges, scan, write_clustered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    want = duck.execute(core.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie")], "id int, name string")


def test_joins_keep_duplicates_and_pad(spark, people):
    o = spark.createDataFrame([(1, 1, "Book"), (2, 1, "Pen"), (3, 2, "Notebook"), (4, 99, "Ghost")], "oid int, user_id int, product string")
    on = people.id == o.user_id
    assert rows(rel.join(people, o, on).select("name", "product")) == [("Alice", "Book"), ("Alice", "Pen"), ("Bob", "Notebook")]
    assert ("Charlie", None) in rows(rel.join(people, o, on, "left").select("name", "product"))
    with pytest.raises(ValueError):
        rel.join(people, o, on, "full")


def test_integer_average_and_division(spark):
    n = spark.createDataFrame([(10,), (5,), (8,), (3,), (12,), (7,), (None,)], "n int")
    assert rel.aggregate(n, total=F.sum("n"), mean=int_avg("n"), all=F.count("*"), some=F.count("n")).first()[:] == (45, 7, 7, 6)
    assert spark.createDataFrame([(1,), (2,), (-6,)], "n int").agg(int_avg("n")).first()[0] == -1
    got = spark.createDataFrame([(7, 2), (-7, 2), (1, 0), (None, 1)], "a int, b int").select(int_div("a", "b")).collect()
    assert [r[0] for r in got] == [3, -3, None, None]
    assert n.filter("n > 99").agg(F.count("n"), int_avg("n")).first()[:] == (0, None)


def test_null_logic(spark):
    b = spark.createDataFrame([(x, y) for x in (True, False, None) for y in (True, False, None)], "a boolean, b boolean")
    for r in b.select("a", "b", strict_and(F.col("a"), F.col("b")).alias("x"), strict_or(F.col("a"), F.col("b")).alias("y")).collect():
        none = r.a is None or r.b is None
        assert r.x == (None if none else r.a and r.b) and r.y == (None if none else r.a or r.b)


def test_errors(spark, people):
    with pytest.raises(ValueError):
        scan(spark, SF, "nothing")
    with pytest.raises(ValueError):
        changes.insert(people, (1,))
    with pytest.raises(TypeError):
        changes.insert(people, ("x", "y"))
    with pytest.raises(ValueError):
        changes.update(people, {"age": F.lit(1)})
    for bad in (lambda: people.filter(F.sum("id") > 1), lambda: people.groupBy("name").agg(F.sum("id")).select("id"), lambda: people.select("age")):
        with pytest.raises(AnalysisException):
            bad().collect()


def test_changes_see_old_values(spark, people):
    swapped = changes.update(people, {"id": F.length("name"), "name": F.col("id").cast("string")}, F.col("id") > 1)
    assert rows(swapped) == [(1, "Alice"), (3, "2"), (7, "3")]
    assert rows(changes.delete(changes.insert(people, (4, None)), F.col("name") != "Bob")) == [(2, "Bob"), (4, None)]


def test_transactions(spark, tmp_path, people):
    tables = VersionedTables(spark, f"file://{tmp_path}")
    tables.publish("people", people)
    a, b = tables.begin(), tables.begin()
    a.write("people", changes.delete(a.read("people"), F.col("id") == 2))
    assert a.read("people").count() == 2 and b.read("people").count() == 3
    a.commit()
    assert b.read("people").count() == 3 and tables.read("people").count() == 2 and tables.read("people", 1).count() == 3
    b.write("people", changes.insert(b.read("people"), (9, "Zoe")))
    with pytest.raises(ConflictError):
        b.commit()
    c = tables.begin()
    c.write("people", c.read("people").limit(0))
    c.rollback()
    assert tables.read("people").count() == 2
    with pytest.raises(RuntimeError):
        c.commit()


@pytest.mark.parametrize(("keys", "start", "end", "want"), [
    (list(range(0, 100, 10)), 25, 65, [30, 40, 50, 60]), ([10, 20, 20, 20, 30, 40, 40, 50], 20, 45, [20, 20, 20, 30, 40, 40]),
    ([50] * 1000, 50, 51, [50] * 1000), ([10, 20, 30], 100, 200, []), (list(range(0, 100, 10)), 50, 50, []), (list(range(10, 20)), 0, 15, [10, 11, 12, 13, 14]),
    ([None, 10, -5], None, None, [None, -5, 10]), (list(range(500)), 100, 200, list(range(100, 200))),
])
def test_range_scans(spark, keys, start, end, want):
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    assert [r.k for r in rel.range_scan(df, "k", start, end).orderBy(F.col("k").asc_nulls_first()).collect()] == want


def test_clustered_layout_prunes(spark, tmp_path):
    write_clustered(scan(spark, SF, "orders"), f"file://{tmp_path}/o", ["o_orderkey"], 4)
    found = rel.lookup(spark.read.parquet(f"file://{tmp_path}/o"), "o_orderkey", 42)
    assert found.count() == 1 and "EqualTo(o_orderkey,42)" in found._jdf.queryExecution().toString()


def test_catalog(spark):
    schemas = {"people": spark.createDataFrame([], "id int, name string, ok boolean, x double").schema}
    assert rows(catalog.pg_class(spark, schemas)) == [(0, "people", None)]
    assert [r.data_type for r in catalog.pg_attribute(spark, schemas).orderBy("ordinal_position").collect()] == [0, 1, 2, None]
    assert rows(catalog.pg_index(spark, schemas, {"i": ("people", ["name", "id"])})) == [(0, "i", 0, "1,0", None)]


def test_import_without_the_text_operators(tmp_path):
    """The entry file works when the text subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(core.__file__).parents[2]
    shutil.copytree(repo / "granary", tmp_path / "granary", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and 'flagship' in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_clustered_lookup_skips_row_groups(spark, tmp_path):
    """One of eight files has the key in its statistics, and Spark reads no more than that file's rows."""
    import pyarrow.parquet as pq

    path = f"{tmp_path}/index"
    write_clustered(scan(spark, SF, "orders"), path, ["o_orderkey"], 8)
    ranges = []
    for f in (tmp_path / "index").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().get_field_index("o_orderkey")
        ranges += [(g.column(at).statistics.min, g.column(at).statistics.max, g.num_rows) for g in map(meta.row_group, range(meta.num_row_groups))]
    hit = [r for r in ranges if r[0] <= 420 <= r[1]]
    assert len(ranges) == 8 and len(hit) == 1
    df = rel.lookup(spark.read.parquet(f"file://{path}"), "o_orderkey", 420)
    assert "EqualTo(o_orderkey,420)" in df._jdf.queryExecution().executedPlan().toString()
    assert [r["o_orderkey"] for r in df.collect()] == [420]
    read = spark.read.parquet(f"file://{path}").filter("o_orderkey = 420 OR o_orderkey = -1")
    assert read.count() == 1


def test_clustered_ranges_stay_bounded(spark, tmp_path):
    """A larger table gets more ranges, not larger ones, and a key with most of the rows doesn't land in one task."""
    import pyarrow.parquet as pq

    df = spark.range(1_000_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), "id", F.repeat(F.lit("x"), 300).alias("text"))
    write_clustered(df, f"file://{tmp_path}/index", ["k"], 2)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in (tmp_path / "index").glob("*.parquet")]
    assert sum(sizes) == 1_000_000 and max(sizes) * 340 < 100e6
    found = spark.read.parquet(f"file://{tmp_path}/index")
    assert found.agg(F.count("*"), F.sum("id"), F.countDistinct("id")).first()[:] == (1_000_000, 499_999_500_000, 1_000_000)
    assert rel.lookup(found, "k", -1).count() == 900_000 and rel.range_scan(found, "k", 100, 130).count() == 3


def test_clustered_ranges_follow_the_bytes(spark):
    empty = spark.createDataFrame([], "k long, text string, more array<int>")
    assert ranges(empty, 8) == 8
    wide = spark.range(1000).select("id", F.lit(None).cast("string").alias("none"), F.array(*[F.repeat(F.lit("é"), 50_000)] * 2).alias("more"))
    assert ranges(wide, 1) == 3


def test_create_table_and_its_errors(spark):
    catalog.create_table(spark, "made_once", "id INT, name STRING")
    try:
        spark.sql("INSERT INTO made_once VALUES (1, 'Alice')")
        assert rows(spark.table("made_once")) == [(1, "Alice")]
        for bad in ("CREATE TABLE made_once (id INT) USING parquet", "SELECT * FROM nowhere", "SELECT nothing FROM made_once", "INSERT INTO made_once VALUES (1)"):
            with pytest.raises(AnalysisException):
                spark.sql(bad)
        with pytest.raises(AnalysisException):
            catalog.create_table(spark, "made_once", "id INT, name STRING")
        with pytest.raises(AnalysisException):
            catalog.create_table(spark, "made_twice", "id INT, id STRING")
    finally:
        spark.sql("DROP TABLE IF EXISTS made_once")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from granary.session import shared_folder

    none = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(none)
