"""Steps over few rows are stored in few partitions, whatever the number of shuffle partitions."""

import random

from riskweave.llm import bagminhash as bm


def test_labels_of_few_links_are_few_files(spark, monkeypatch):
    stored = []
    pin = bm.pin
    monkeypatch.setattr(bm, "pin", lambda df, label="pinned": stored.append((label, df.rdd.getNumPartitions())) or pin(df, label))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        drawn = random.Random(3)
        nodes = list(range(100, 124))
        links = [(a, drawn.choice(nodes[i - i % 8:i])) for i, a in enumerate(nodes) if i % 8]  # three trees
        rows = spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long")
        got = {r["node"]: r["comp"] for r in bm.components(rows).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: root[n] for x in links for n in x}
    assert stored and all(n <= spark.sparkContext.defaultParallelism for _, n in stored)
