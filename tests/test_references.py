from datetime import datetime as dt

from dhruva.operators.references import Parent, id_key, orphan_counts, orphan_references

REFS = "link_id long, parent string, raw string, at timestamp_ntz, month string, p string, lives string"


def _refs(spark, rows):
    return spark.createDataFrame(rows, REFS).withColumn("key", id_key("raw"))


def _parents(spark, rows):
    stops = spark.createDataFrame(rows, "stop_id string, since timestamp_ntz, until timestamp_ntz, key string")
    hubs = spark.createDataFrame([("HUB_A",)], "hub_id string")
    return {"stops": Parent("stops", stops, "stop_id", "since", "until"), "hubs": Parent("hubs", hubs, "hub_id")}


def test_lifetimes_dirty_ids_and_clashing_columns(spark):
    a, b, c, d = (dt(2024, m, 1) for m in (1, 3, 5, 7))
    parents = _parents(spark, [("S1", a, b, "x"), ("S1", c, None, "x"), ("s2 ", a, None, "x"), ("S2", a, None, "x"), ("S3", b, b, "x"), (None, a, None, "x")])
    refs = _refs(spark, [
        (1, "stops", "S1", a, "m", "p", "l"), (2, "stops", " s1", b, "m", "p", "l"), (3, "stops", "S1", c, "m", "p", "l"), (4, "stops", "S2", d, "m", "p", "l"), (5, "stops", "S3", b, "m", "p", "l"),
        (6, "stops", None, a, "m", "p", "l"), (7, "stops", "  ", a, "m", "p", "l"), (8, "stops", "S9", a, None, "p", "l"), (9, "hubs", "hub_a", a, "m", "p", "l"), (10, "hubs", "HUB_B", a, "m", "p", "l"),
        (11, None, "S1", a, "m", "p", "l"), (12, "stops", "S1", None, "m", "p", "l"), (2, "stops", " s1", b, "m", "p", "l"),
    ])
    out = orphan_references(refs, parents)
    assert sorted(r["link_id"] for r in out.collect()) == [2, 2, 5, 8, 10, 11]
    assert out.columns == refs.columns
    counts = {(r["parent"], r["month"]): (r["references"], r["orphans"], r["missing_keys"]) for r in orphan_counts(refs, parents, "month").collect()}
    assert counts == {("stops", "m"): (7, 3, 2), ("stops", None): (1, 1, 1), ("hubs", "m"): (2, 1, 1), (None, "m"): (1, 1, 1)}


def test_empty_tables(spark):
    none = _parents(spark, [])
    assert orphan_references(_refs(spark, []), none).count() == 0
    assert orphan_references(_refs(spark, [(1, "stops", "S1", dt(2024, 1, 1), "m", "p", "l")]), none).count() == 1


def test_hot_missing_key_keeps_every_row(spark):
    df = spark.range(30_000).selectExpr("id as link_id", "'stops' as parent", "if(id % 3 = 0, 'HOT', concat('S', id % 50)) as raw", "timestamp_ntz'2024-02-01' as at", "'m' as month")
    parents = _parents(spark, [(f"S{i}", dt(2024, 1, 1), None, "x") for i in range(50)])
    out = orphan_references(df.withColumn("key", id_key("raw")), parents)
    assert out.count() == 10_000 and out.select("raw").distinct().count() == 1
