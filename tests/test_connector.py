"""The connector data source: batch, stream that stops and goes on, filters, changes, access lists, refusals."""

import pytest
from pyspark.sql import functions as F

from corpusspark.sources import connector as cn

P = "struct<type:string,id:string>"
ROWS = f"external_id string, type string, text string, version string, change string, owner {P}, viewers array<{P}>"


def rows(spark, *own):
    return spark.createDataFrame(list(own), ROWS)


@pytest.fixture
def landing(spark, tmp_path):
    path = str(tmp_path)
    a = rows(spark, ("1", "file", "a", "v1", None, ("user", "u1"), [("role", "member"), ("role", "member")]), ("2", "issue", "b", "v1", "upsert", None, None), ("3", "file", "c", "v1", None, None, []))
    assert cn.land(a, path, "hub", "w1") == 1
    return path


def second(spark):
    return rows(spark, ("1", "file", "a2", "v2", None, ("user", "u1"), None), ("2", "issue", None, None, "removed", None, None), ("3", "file", "c", "v1", None, None, []), ("4", "file", "d", "v1", None, None, None), ("5", "file", None, None, "removed", None, None))


def test_batch(spark, landing):
    cn.land(second(spark), landing, "hub", "w1")
    cn.land(rows(spark, ("9", "file", "x", "v", None, None, None)), landing, "hub", "w2")  # another workspace
    got = cn.objects(spark, landing, "hub", "w1")
    assert got.count() == 8 and {r[0] for r in got.select("workspace_id").distinct().collect()} == {"w1"}
    assert cn.objects(spark, landing, "hub", "w1", after=1).count() == 5
    assert cn.objects(spark, landing, "hub", "w1", include=["issue"]).count() == 2
    assert {(r.external_id, r.change) for r in cn.deltas(got, 1).collect()} == {("1", "updated"), ("2", "removed"), ("4", "added")}
    assert {(r.external_id, r.change) for r in cn.deltas(got, 0).collect()} == {("1", "added"), ("3", "added"), ("4", "added")}
    assert {(r.external_id, r.text) for r in cn.current(got).filter("change = 'upsert'").collect()} == {("1", "a2"), ("3", "c"), ("4", "d")}
    assert cn.objects(spark, landing, "hub", "nobody").count() == 0


def test_filters_reach_the_files(spark, landing):
    cn.land(second(spark), landing, "hub", "w1")
    got = cn.objects(spark, landing, "hub", "w1").filter("external_id = '1' and landed > 1 and type in ('file', 'issue') and text like 'a%'")
    assert [tuple(r) for r in got.select("external_id", "text", "landed").collect()] == [("1", "a2", 2)]
    reader = cn.LandedReader({"path": landing, "provider": "hub", "workspace_id": "w1"})
    left = list(reader.pushFilters([cn.EqualTo(("external_id",), "1"), cn.GreaterThanOrEqual(("landed",), 2), cn.EqualTo(("text",), "x")]))
    assert len(left) == 1 and reader.ids == ["1"] and reader.after == 1 and len({p.number for p in reader.partitions()}) == 1


def test_large_files_are_split(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("external_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    url = cn.Landing(str(tmp_path), "hub", "w1").url
    df.coalesce(1).write.option("parquet.block.size", 200_000).parquet(f"{url}/{1:0{cn.DIGITS}d}")
    splits = cn.Landing(str(tmp_path), "hub", "w1").splits(0, 1, 300_000)
    assert len(splits) > 3
    got = spark.read.format("landed_objects").options(provider="hub", workspace_id="w1", splitBytes=300_000).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == len(splits) and got.select("external_id").distinct().count() == 20_000


def test_stream_stops_and_goes_on(spark, landing):
    hub, seen = cn.Connector("hub", "Hub", acl=True), []
    sink = lambda df, _: seen.append(sorted((r.external_id, r.landed) for r in df.collect()))
    assert cn.sync(hub, spark, landing, "w1", f"{landing}/cp", sink) == {"total": 3, "removed": 0}
    assert seen == [[("1", 1), ("2", 1), ("3", 1)]]
    assert cn.sync(hub, spark, landing, "w1", f"{landing}/cp", sink) == {"total": 0, "removed": 0} and len(seen) == 1
    cn.land(second(spark), landing, "hub", "w1")
    # A batch that isn't whole, and what comes after it, wait.
    rows(spark, ("7", "file", "x", "v", None, None, None)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{cn.Landing(landing, 'hub', 'w1').url}/{3:0{cn.DIGITS}d}")
    assert cn.sync(hub, spark, landing, "w1", f"{landing}/cp", sink) == {"total": 5, "removed": 2}
    assert {n for _, n in seen[1]} == {2} and cn.delta_cursor(landing, "hub", "w1") in (1, 2)


def test_access_lists(spark, landing):
    hub = cn.Connector("hub", "Hub", acl=True)
    assert {tuple(r) for r in cn.fetch_acl(hub, spark, landing, "w1", "1").collect()} == {("user", "u1", "own", False), ("role", "member", "read", False)}
    assert cn.fetch_acl(hub, spark, landing, "w1", "2").collect() == []
    with pytest.raises(cn.ConnectorError) as e:
        cn.fetch_acl(cn.Connector("hub", "Hub"), spark, landing, "w1", "1")
    assert e.value.code == "unsupported"
    cn.land(second(spark), landing, "hub", "w1")
    assert cn.fetch_object(spark, landing, "hub", "w1", "2").count() == 0 and cn.fetch_object(spark, landing, "hub", "w1", "1").first().text == "a2"


def test_refusals(spark, landing):
    r = cn.Registry()
    r.add(cn.Connector("b", "B"))
    r.add(cn.Connector("a", "A"))
    assert [c.provider for c in r.list()] == ["a", "b"] and r.get("a").display_name == "A"
    for code, act in (("unsupported", lambda: r.add(cn.Connector("a", "A"))), ("not_found", lambda: r.get("c")), ("internal", lambda: r.add(cn.Connector(" ", "")))):
        with pytest.raises(cn.ConnectorError) as e:
            act()
        assert e.value.code == code
    with pytest.raises(Exception, match="workspace_id must be given"):
        spark.read.format("landed_objects").option("provider", "hub").load(landing).collect()
    with pytest.raises(cn.ConnectorError):
        cn.Landing(landing, "hub", "../w1")
