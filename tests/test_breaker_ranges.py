"""Ranges of a long log grow in number, not in size."""

from pyspark.sql import functions as F

from newsweave.streaming import breaker


def test_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(breaker, "RANGE_RUNS", 100)
    sizes, real = [], breaker.cut

    def cut(df):
        out = real(df)
        if "_part" in df.columns and "_us" in df.columns:
            sizes.extend(r["count"] for r in out.groupBy("_part").count().collect())
        return out

    monkeypatch.setattr(breaker, "cut", cut)
    log = spark.range(6_000).select(
        F.lit("rss").alias("source"), F.timestamp_seconds(F.col("id") * 60).alias("started_at"), F.col("id").alias("run_id"), F.when(F.col("id") % 7 == 0, "success").otherwise("error").alias("status")
    )
    got = {r.run_id: (r.failures, r.open) for r in breaker.breaker_states(log).collect()}
    found, _ = breaker.follow(breaker.CLOSED, [k * 60_000_000 for k in range(6_000)], ["success" if k % 7 == 0 else "error" for k in range(6_000)], 3, 3600)
    assert got == {k: (f, o is not None) for k, (f, o) in enumerate(found)}
    assert len(sizes) >= 40 and max(sizes) < 500
