from __future__ import annotations

import numpy as np

from lumenlake.streaming.extraction import extract_stream

SCHEMA = "image string, height int, width int, pixels array<double>, mask array<int>"


def test_each_file_once(spark, tmp_path):
    y, x = np.mgrid[:40, :40]
    pixels, mask = (x * y / 40.0).ravel().tolist(), ((x - 20) ** 2 + (y - 20) ** 2 < 200).astype(int).ravel().tolist()
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for name in ("a", "b"):
        spark.createDataFrame([(name, 40, 40, pixels, mask)], SCHEMA).write.mode("append").parquet(source)
        extract_stream(spark, source, SCHEMA, ["image"], sink, state, ["basic"]).awaitTermination()
    rows = spark.read.parquet(sink).collect()
    assert sorted(r["image"] for r in rows) == ["a", "b"] and all(r["failure"] is None for r in rows)
