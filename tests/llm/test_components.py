"""Connected components in few parts."""

from pyspark.sql import functions as F

from tastemill.llm import components as module


def test_few_edges_stay_in_few_parts(spark, monkeypatch):
    parts, saved = [], module.saved
    monkeypatch.setattr(module, "saved", lambda df: parts.append(df.rdd.getNumPartitions()) or saved(df))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # A chain of ten and a star, given backwards and twice, with a self-link.
        chain = spark.range(1, 10).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
        star = spark.range(21, 30).select(F.lit(20).cast("long").alias("u"), F.col("id").alias("v"))
        edges = chain.unionByName(star).unionByName(star).unionByName(spark.createDataFrame([(50, 50)], "u long, v long"))
        found = sorted(map(tuple, module.components(edges).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == [(i, 0) for i in range(1, 10)] + [(i, 20) for i in range(21, 30)]
    assert len(parts) > 1 and max(parts[1:]) <= module.LEAST_PARTS
