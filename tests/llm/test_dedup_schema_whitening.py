"""Exact dedup, schema inference and whitening against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import exact_dedup, queries, schema_inference, whitening

SPACE = re.compile(r"[\x20\x09-\x0D]+")

# ------------------------------------------------------------------ exact dedup


def brute_groups(rows):
    texts = [SPACE.sub(" ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t].append(i)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    best = {t: min(g, key=order) for t, g in groups.items()}
    return Counter((rows[i][0], rows[best[t]][0], len(groups[t]), best[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts))


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [f"text {int(k)}" for k in rng.zipf(1.3, 3000) % 500]
    texts = [t.replace(" ", [" ", "  ", "\t", " \n\x0b"][int(rng.integers(4))]) for t in texts]
    rows = list(zip(map(int, rng.permutation(3000)), texts, strict=True))
    rows += [(None, "text 1"), (None, "only null"), (None, "only null"), (5000, None), (5001, ""), (5002, " "), (5003, "\n\t"), (5004, " "), (5005, " a "), (5005, " a "), (5006, "x" * 300_000), (5007, "x" * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(40).withColumns({c: F.lit(1) for c in ("row", "run", "digest", "kept", "size", "keeper", "length")})
    got = exact_dedup.groups(frame)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_groups(rows)


def test_many_runs_take_several_rounds(spark):
    """A run's number has as many digits as there are rounds; the copies of one text meet FAN at a time."""
    docs = spark.range(6000, numPartitions=300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("text"))
    lines = exact_dedup.runs(docs.withColumn("row", F.monotonically_increasing_id()))
    level = lines.select("run", "keeper", *exact_dedup.TEXT, F.lit(1).alias("size"))
    hot = []
    for r in range(3):
        level = level.withColumn("run", exact_dedup._exchanged(r)).groupBy("run", *exact_dedup.TEXT).agg(F.min("keeper").alias("keeper"), F.sum("size").alias("size")).checkpoint()
        hot.append(level.where("length = 8").count())
    assert hot[0] <= 20 and hot[2] == 1
    assert level.count() == level.select(*exact_dedup.TEXT).distinct().count()
    got = exact_dedup.groups(docs)
    assert Counter(map(tuple, got.collect())) == brute_groups([tuple(r) for r in docs.collect()])


def test_distinct_keeps_columns(spark):
    rows = [(2, "a  b", "x"), (1, "a b", "y"), (1, "a b", "z"), (3, "c", None), (None, "c", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = exact_dedup.distinct(frame)
    assert got.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "a b"), (3, "c")]
    assert exact_dedup.groups(frame.limit(0)).count() == 0 and exact_dedup.distinct(frame.limit(0)).count() == 0


# ------------------------------------------------------------------ schema inference


def brute_schema(rows, most=12):
    """The schema by a tree of plain dictionaries; rows are (client_id, click_id, props)."""
    forest, bad = [], Counter()
    for client, click, text in rows:
        g = 0 if client is None else client % 30
        x = zlib.crc32(("" if click is None else str(click)).encode()) % (g % 37 + 1)
        try:
            v = json.loads(text, parse_constant=lambda c: 1 / 0)
        except (TypeError, ValueError, ZeroDivisionError):
            v = None
        if not isinstance(v, dict):
            bad[f"!g{g}"] += 1
            continue
        forest.append({f"g{g}": {f"x{x}": [v] if click is not None and click % 5 == 0 else v}})
    out = {p: (f"bad:{n}", 0, False, False, None, None) for p, n in bad.items()}
    kind = {type(None): "null", bool: "boolean", int: "integer", float: "double", str: "string", list: "array", dict: "object"}

    def walk(path, values, optional):
        count = Counter(kind[type(v)] for v in values)
        objects = [v for v in values if isinstance(v, dict)]
        arrays = [v for v in values if isinstance(v, list)]
        names = {k for o in objects for k in o}
        is_map = path != "$" and len(names) > most
        lengths = [len(a) for a in arrays]
        out[path] = ("|".join(f"{k}:{n}" for k, n in sorted(count.items())), len(names), is_map, optional, min(lengths, default=None), max(lengths, default=None))
        if is_map:
            walk(path + ".*", [v for o in objects for v in o.values()], False)
        else:
            for k in names:
                below = [o[k] for o in objects if k in o]
                walk(f"{path}.{k}", below, k != "*" and len(below) < len(objects))
        below = [e for a in arrays for e in a]
        if below:
            walk(path + "[]", below, False)

    if forest:
        walk("$", forest, False)
    return out


def schema_of(frame):
    rows = frame.collect()
    assert frame.columns == ["path", "types", "n_names", "is_map", "optional", "min_len", "max_len"]
    assert len({r["path"] for r in rows}) == len(rows)
    return {r["path"]: tuple(r)[1:] for r in rows}


def test_schema_of_clicks_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/clicks.parquet").select("client_id", "click_id", "props").collect()]
    got = schema_of(queries.QUERIES["op12_schema_inference"](spark, sf_dir))
    assert got == brute_schema(rows)
    assert got["$.g20"][2] and not got["$.g5"][2] and not got["$"][2] and "!g0" in got


def test_schema_of_odd_texts(spark):
    wide = {f"n{i}": {"a": i, "deep": {f"m{i}{j}": j for j in range(3)}} for i in range(20)}
    texts = [None, "", "  ", "{}", "[]", "3", "null", '{"a": NaN}', '{"a": 1} x', ' {"a": 1}\n', '{"a": 1e3, "b": -0, "c": 1.0, "d": "\\ud800"}', '{"a": ' + "9" * 5000 + "}"]
    texts += [json.dumps(wide), json.dumps({"list": [1, None, [], [[]], {"z": True}, {"y": [1.5]}]}), json.dumps({"*": 1, "b.c": {"[]": 2}}), json.dumps({"t": "x" * 200_000}), json.dumps({"many": list(range(20_000))})]
    texts += [json.dumps({"k": {f"key{i}": {f"r{i % 7}": 1}}}) for i in range(40)] + [json.dumps({"k": [i]}) for i in range(3)]
    rows = [(None if i % 11 == 0 else i * 7, None if i % 13 == 0 else i, t) for i, t in enumerate(texts * 3)]
    frame = spark.createDataFrame(rows, "client_id long, click_id long, props string").withColumns({c: F.lit("x") for c in ("steps", "n", "low", "names", "above")})
    places = schema_inference.click_places(frame)
    one_place = spark.createDataFrame([(None, 0, t) for t in texts for _ in range(2)], "client_id long, click_id long, props string")

    def expected(given):
        fixed = [(c, k, t.replace("9" * 5000, "9") if t else t) for c, k, t in given]  # Python refuses to convert it
        return {p.replace("\ud800", "�"): v for p, v in brute_schema(fixed).items()}

    assert schema_of(schema_inference.infer(places)) == expected(rows)
    one = schema_of(schema_inference.infer(schema_inference.click_places(one_place)))
    assert one == expected([(None, 0, t) for t in texts for _ in range(2)])
    assert one["$.g0.x0[]"][2] and one["$.g0.x0[].*.*.deep" if "$.g0.x0[].*.*.deep" in one else "$.g0.x0[].*.*"]


def test_too_deep_and_empty(spark):
    deep = '{"a":' * 600 + "1" + "}" * 600
    deeper = '{"a":' * 200_000 + "1" + "}" * 200_000
    fine = '{"a":' * 400 + "1" + "}" * 400
    frame = spark.createDataFrame([(0, 1, deep), (0, 1, deeper), (0, 1, fine)], "client_id long, click_id long, props string")
    got = schema_of(schema_inference.infer(schema_inference.click_places(frame)))
    assert got["!g0"][0] == "bad:2" and got["$.g0.x0" + ".a" * 400][0] == "integer:1"
    assert schema_inference.infer(schema_inference.click_places(frame.limit(0))).count() == 0


def test_each_text_is_parsed_once(monkeypatch):
    import pyarrow as pa

    calls = []
    shape = schema_inference.shape
    monkeypatch.setattr(schema_inference, "shape", lambda t: calls.append(t) or shape(t))
    texts = [t for t in ('{"a": 1}', '{"b": 2}', None) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([f"g{i % 30}" for i in range(150)]), pa.array(["x0"] * 150), pa.array([i % 2 == 0 for i in range(150)]), pa.array([3] * 150)], names=["text", "outer", "inner", "wrapped", "n"])
    rows = [r for b in schema_inference.counters(iter([batch])) for r in b.to_pylist()]
    assert len(calls) == 3
    assert sum(r["n"] for r in rows if r["steps"] == ["$"]) == 300
    assert sum(r["n"] for r in rows if r["kind"] == "bad") == 150


def test_few_kept_counters_give_the_same(spark, sf_dir, monkeypatch):
    import pyarrow as pa

    rows = [('{"k": {"a%d": [%d]}}' % (i, i), "g1", "x1", i % 2 == 0, 2) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["text", "outer", "inner", "wrapped", "n"])

    def total():
        out = Counter()
        for b in schema_inference.counters(iter([batch])):
            for r in b.to_pylist():
                out[tuple(r["steps"]), r["kind"]] += r["n"]
        return out

    whole = total()
    monkeypatch.setattr(schema_inference, "MOST_KEPT", 20)
    assert total() == whole


# ------------------------------------------------------------------ whitening


def brute_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    dev = [sum(int(v) ** 2 for v in row) for row in (x * n - s)]
    y = (x * n - s) / n
    values, turned = np.linalg.eigh(y.T @ y / n)
    values, turned = values[::-1][:k], turned[:, ::-1][:, :k]
    return n, dev, y @ turned / np.sqrt(values), values / np.trace(y.T @ y / n)


def check_whitening(rows, ids, vectors):
    n, dev, w, share = brute_whitening(vectors)
    place = {v: i for i, v in enumerate(ids)}
    got = np.full_like(w, np.nan)
    for r in rows:
        i = place[r["vec_id"]]
        assert r["n"] == n and int(r["deviation"]) == dev[i]
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-6)
        assert r["identity_error"] < 1e-8
        got[i, r["component"] - 1] = r["whitened"]
    assert len(rows) == got.size and not np.isnan(got).any()
    for j in range(w.shape[1]):
        assert min(np.abs(got[:, j] - w[:, j]).max(), np.abs(got[:, j] + w[:, j]).max()) < 1e-6


def test_whitening_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [r for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    got = queries.QUERIES["op13_whitening"](spark, sf_dir)
    assert dict(got.dtypes).items() >= {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}.items()
    check_whitening(got.collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_of_many_partitions_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 10)) @ rng.normal(size=(10, 10)) + rng.normal(size=10) * 5
    rows = [(i, [float(c) for c in v], i) for i, v in enumerate(base)]
    odd = [(9001, None, 0), (9002, [1.0] * 9 + [None], 0), (9003, [float("nan")] + [0.0] * 9, 0), (9004, [float("-inf")] + [0.0] * 9, 0)]
    short = [(9005, [0.5] * 4, 0), (9006, [], 0)]
    frame = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<double>, component int").repartition(300)
    vectors = [v for _, v, _ in rows] + [[0.5] * 4 + [0.0] * 6, [0.0] * 10]
    check_whitening(whitening.whiten(frame).collect(), [*range(700), 9005, 9006], vectors)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    rows = whitening.whiten(flat).collect()
    assert len(rows) == 10 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["deviation"] == 0 for r in rows)
    line = spark.createDataFrame([(i % 3, [float(i), -2.0 * i, 3.0]) for i in range(9)], schema)
    rows = whitening.whiten(line).collect()
    assert len(rows) == 27
    assert {r["whitened"] is None for r in rows if r["component"] == 1} == {False} and {r["whitened"] for r in rows if r["component"] > 1} == {None}
    assert rows[0]["identity_error"] < 1e-9
    for empty in (line.limit(0), spark.createDataFrame([(1, None)], schema), spark.createDataFrame([(1, [])], schema)):
        got = whitening.whiten(empty)
        assert got.count() == 0 and got.columns == whitening.whiten(line).columns
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (None, [0.0, 2.0])], schema)
    rows = whitening.whiten(huge).collect()
    assert len(rows) == 6 and sum(r["vec_id"] is None for r in rows) == 2
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([(1, [0.0] * 5000)], schema))


def test_exact_square_sums():
    v = np.array([[3, -4], [(1 << 51) + 1, 7]])
    assert whitening.square_sums(v) == [25, ((1 << 51) + 1) ** 2 + 49]
    assert whitening.square_sums(np.array([[1 << 60]])) == [1 << 120]
    assert whitening.square_sums(np.array([[10**30]], object)) == [10**60]


def test_small_variances_keep_their_digits(spark):
    """Variances of twelve orders apart: a covariance in double precision would lose the small ones."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) * np.array([1e6, 1.0, 1e3, 30.0])
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = whitening.fit(frame, 4)
    assert whitening.identity_error(frame, model) < 1e-6
    assert model.variances[-1] == pytest.approx(1024.0**2, rel=0.3)
