"""Every query against its SQL on the smallest tables, and streams against batches."""

import os

import duckdb
import pytest

import __spark_entry__
from ledgerlens import registry
from ledgerlens.operators import triggers
from ledgerlens.sources.records import activity
from ledgerlens.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(frame, columns):
    return sorted(repr(tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x for x in row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, expected = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert plain(got, columns) == plain(expected, columns)


@pytest.fixture(params=["samples", "sizes"])
def many_ranges(spark, request):
    """Range partitioning as on large tables: bounds from small samples, or neighbouring ranges joined by their bytes."""
    joined = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.shuffle.partitions": "40"}
    unjoined = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "1"}
    conf = unjoined if request.param == "samples" else joined
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["derive_commit", "ingest_append", "promotion_rows"])
def test_numbers_do_not_depend_on_ranges(spark, duck, many_ranges, name):
    got, expected = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.SQL[name]).df()
    columns = sorted(expected.columns)
    assert plain(got, columns) == plain(expected, columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("arriving") / "log")
    log = activity(spark, SF).select("seq", "entity", "ready", "occurred_at", "k")
    log.orderBy("seq").coalesce(1).write.parquet(folder)
    return folder, log.schema


def test_passes_append_and_evaluate(spark, arriving, tmp_path):
    folder, schema = arriving
    seen = []
    stream = spark.readStream.schema(schema).parquet(folder)
    incremental.pass_by_pass(stream, f"{tmp_path}/log", f"{tmp_path}/state", lambda s, log, n: seen.append(log.count())).awaitTermination(120)
    assert seen and seen[-1] == spark.read.parquet(folder).count()


def test_quiet_stream_equals_batch(spark, arriving, tmp_path):
    folder, schema = arriving
    stream = incremental.quiet_sessions(spark.readStream.schema(schema).parquet(folder), "6 hours", "0 seconds")
    stream.writeStream.format("memory").queryName("quiet").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    batch = triggers.quiet_periods(spark.read.parquet(folder), 6 * 3600 - 1)
    assert spark.sql("SELECT entity, n FROM quiet").exceptAll(batch.select("entity", "n")).count() == 0
    assert spark.table("quiet").count() == batch.count()


def test_accumulator_stream(spark, arriving, tmp_path):
    folder, schema = arriving
    stream = incremental.accumulate(spark.readStream.schema(schema).parquet(folder), "k", 200.0)
    stream.writeStream.format("memory").queryName("fired").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(180)
    rows = spark.read.parquet(folder).where("ready").orderBy("seq").collect()
    expected, sums = [], {}
    for r in rows:
        n, x = sums.get(r["entity"], (0, 0.0))
        n, x = n + 1, x + (r["k"] or 0)
        if x >= 200:
            expected.append((r["entity"], n, float(x)))
            n, x = 0, 0.0
        sums[r["entity"]] = (n, x)
    assert sorted(tuple(r) for r in spark.table("fired").collect()) == sorted(expected)


def test_state_tables_follow_the_log(spark, arriving, tmp_path):
    folder, _ = arriving
    log = activity(spark, SF)
    parts = str(tmp_path / "parts")
    log.repartition(4).write.parquet(parts)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    incremental.keep_state(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination(180)
    last = max(int(n.split("=")[1]) for n in os.listdir(f"{tmp_path}/state/heads"))
    from ledgerlens.operators.heads import SLOT, heads

    got = incremental.heads_state(spark, f"{tmp_path}/state", last, log.schema).select("id").collect()
    assert last == 3 and sorted(r["id"] for r in got) == sorted(r["id"] for r in heads(log, SLOT).select("id").collect())
    counts = spark.read.parquet(f"{tmp_path}/state/counts/batch={last}").collect()
    assert sum(r["n"] for r in counts) == log.count()


def test_index_follows_upserts_and_deletes(spark, tmp_path):
    schema = "id long, text string, deleted boolean"
    for k, rows in enumerate(([(1, "a", False), (2, "b", False)], [(2, "c", False), (3, "d", False)], [(1, None, True)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.index_sink(stream, f"{tmp_path}/index", f"{tmp_path}/check").awaitTermination(120)
        found = {r["id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/index/version={k}").collect()}
        assert found == ({1: "a", 2: "b"}, {1: "a", 2: "c", 3: "d"}, {2: "c", 3: "d"})[k]
