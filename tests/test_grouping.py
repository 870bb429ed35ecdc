import pandas as pd
from pyspark.sql import functions as F

from rotamera.operators import grouping as G


def _frame(spark, n=500):
    rows = [(None if i % 50 == 49 else i % 7 if i % 3 else 0, i, float((i * 37) % 101))
            for i in range(n)]
    return spark.createDataFrame(rows, "k int, id long, v double")


def _expected(df):
    pdf = df.toPandas()
    pdf["k"] = pdf["k"].astype("float").fillna(-1)
    return pdf


def test_stats_reach_every_row(spark):
    df = _frame(spark)
    got = _expected(G.attach_stats(df, ["k"], lo=F.min("v"), n=F.count(F.lit(1))))
    assert len(got) == 500
    want = got.groupby("k")["v"].agg(["min", "size"])
    assert (got["lo"] == got["k"].map(want["min"])).all()
    assert (got["n"] == got["k"].map(want["size"])).all()


def test_stats_without_room_to_broadcast(spark, monkeypatch):
    """Hot groups by broadcast, the rest by shuffle, nothing lost, not even a NULL key."""
    monkeypatch.setattr(G, "BROADCAST_ROWS", 6)
    df = _frame(spark)
    got = _expected(G.attach_stats(df, ["k"], lo=F.min("v")))
    assert len(got) == 500 and sorted(got["id"]) == list(range(500))
    assert (got["lo"] == got["k"].map(got.groupby("k")["v"].min())).all()


def test_rank_equals_window_rank(spark):
    df = _frame(spark).repartition(5)
    got = _expected(G.ranked(df, ["k"], [F.col("v").desc(), F.col("id")]))
    want = got.sort_values(["k", "v", "id"], ascending=[True, False, True])
    want["w"] = want.groupby("k").cumcount() + 1
    assert (want["rank"] == want["w"]).all() and len(want) == 500


def test_split_by_size(spark):
    small, large = G.split_by_size(_frame(spark), ["k"], 60)
    assert small.count() + large.count() == 500
    assert {r.k for r in large.select("k").distinct().collect()} == {0, 1, 2, 4, 5} - {
        k for k, n in pd.Series([r.k for r in _frame(spark).collect()]).value_counts().items()
        if n <= 60}
    assert G.split_by_size(_frame(spark), ["k"], 10_000)[1] is None


def test_dealt_runs_keep_all_rows_and_split_hot_groups(spark):
    df = _frame(spark)
    out = G.dealt_runs(df, ["k"], 100, F.xxhash64("id")).withColumn("p", F.spark_partition_id())
    pdf = _expected(out)
    assert sorted(pdf["id"]) == list(range(500))
    per = pdf.groupby("k")["p"].nunique()
    assert per[0] > 1 and (per.drop(0) == 1).all()
