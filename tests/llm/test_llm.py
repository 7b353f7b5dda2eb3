"""The operators of the subpackage against brute force, round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import ann, bpe, chat, components, fingerprint, html_extract, jaccard_join, langid, lm_score, mixing, queries, shared, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.5, n) % vocabulary)


def edit(rng, text, n):
    w = text.split(" ")
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"new{int(rng.integers(1e9))}"
    return " ".join(w)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, blank and very long texts, ties, repeated rows, extra columns with names that operators use."""
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "a b c d e f", "en", "s", 11, 1, 0.5),
        (1, "a b c d e f", "en", "s", 11, 1, 0.5),
        (2, None, "en", "s", None, 1, None),
        (3, "", None, None, 0, None, 0.1),
        (4, " \t\n ", "de", "t", 4, 1, 0.1),
        (None, "a b c d e f", None, "t", 11, 2, 0.1),
        (5, long_text, "fr", None, len(long_text), 3, 0.1),
        (6, "Zürich \U0001f642 <|endoftext|> 12", "de", "s", 20, 3, 0.1),
        (7, "12 !! ...", "es", "u", 9, 3, 0.1),
    ]
    return spark.createDataFrame(rows, DOC + ", size long, score double").withColumns({c: F.lit(1) for c in ("set_id", "sig", "n", "root", "copies", "rank", "b", "packed", "place", "taken")})


# ------------------------------------------------------------------ kernels


def test_shingle_kernel_counts_like_python():
    rng = np.random.default_rng(0)
    texts = ["", "a", "A a", "a b c d", "a b c d e", "a b c d e a b c d e a b c d e", "\x1c a\x85b  ", None] + [prose(rng, int(n)) for n in rng.integers(0, 60, 50)]
    seen = {}
    for i, part in shared.shingle_sets(pa.array(texts)):
        want = shingles(texts[i])
        assert len(part) == len(want)
        for h in part.tolist():
            seen.setdefault(h, set()).add(i)
    assert shared.shingle_sets(pa.array([], pa.string())) is not None and list(shared.shingle_sets(pa.array([], pa.string()))) == []
    sliced = list(shared.shingle_sets(pa.array(["x y"] + texts).slice(1)))
    assert [len(p) for _, p in sliced] == [len(shingles(t)) for t in texts]
    assert len(next(iter(shared.shingle_sets(pa.array(["A B C"]))))[1] ^ next(iter(shared.shingle_sets(pa.array(["a b c"]))))[1]) == 1


def test_chunks_cover_all_rows():
    texts = ["x" * 10] * 5 + ["y" * (3 << 20)] + [None, "z"]
    rows = [(row + i, offs[i + 1] - offs[i]) for row, _, offs in shared.text_chunks(pa.array(texts)) for i in range(len(offs) - 1)]
    assert rows == [(i, len(t or "")) for i, t in enumerate(texts)]


# ------------------------------------------------------------------ op1


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        free = [s for s in names if s not in capped]
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: capped.get(s, level * w[s]) for s in names}
        for s in over:
            capped[s] = most * sizes[s]


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, int(rng.integers(0, 80))), "en", ["a", "b", "c", "d", None, "B"][int(rng.choice(6, p=[0.5, 0.02, 0.2, 0.08, 0.1, 0.1]))], 0) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).toPandas()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    want = brute_targets(sizes)
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    for source, target in want.items():
        part = got[got["source"].isna() if source is None else got["source"] == source]
        assert part["target"].iloc[0] == pytest.approx(target)
        assert abs(part["taken"].sum() - target) <= max(0.05 * target, 80)
        assert (part["taken"] <= 3 * part["size"]).all() and part["source_size"].iloc[0] == sizes[source]
        assert set(part["copies"]) <= {int(np.floor(target / sizes[source])), int(np.ceil(target / sizes[source]))}
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOC).repartition(7)).toPandas()
    assert got.set_index("doc_id")["copies"].sort_index().equals(again.set_index("doc_id")["copies"].sort_index())
    docs = spark.createDataFrame(rows, DOC)
    emitted = mixing.emit(docs, mixing.mix(docs))
    assert emitted.columns == docs.columns and emitted.count() == got["copies"].sum()


def test_mixing_emits_each_row_s_own_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else i // 4, prose(rng, int(rng.integers(0, 60))), "en", ["a", "b", "c", None][int(rng.choice(4, p=[0.05, 0.1, 0.8, 0.05]))], i) for i in range(1200)]
    docs = spark.createDataFrame(rows, DOC)
    mixed = mixing.mix(docs)
    want = {tuple(r)[:3]: r["copies"] for r in mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies")).where("copies > 0").collect()}
    out = mixing.emit(docs, mixed)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"]))) for r in out.collect())
    assert got == want and None in {k[0] for k in got} and None in {k[1] for k in got}


def test_mixing_edges(spark, odd):
    out = mixing.mix(odd).toPandas()
    assert len(out) == 9 and out.loc[out["size"] == 0, "taken"].sum() == 0
    assert mixing.mix(odd.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None)], DOC)
    assert tuple(mixing.mix(blank).select("size", "target", "taken").first()) == (0, 0.0, 0)


# ------------------------------------------------------------------ op2


def test_fingerprints_estimate_jaccard(spark):
    rng = np.random.default_rng(2)
    texts = [prose(rng, int(n)) for n in rng.integers(0, 300, 60)]
    rows = [(int(i) * 7, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = fingerprint.compared(spark.createDataFrame(rows, DOC)).toPandas().set_index("doc_id")
    order = sorted(rows, key=lambda r: -r[0])
    errors = []
    for i, (key, text, *_) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        row = got.loc[key]
        assert row["n_chars"] == n and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, value in ((edited, row["near_edited"]), (after, row["near_next"])):
            a, b = shingles(text), shingles(other)
            errors.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
            assert 0 <= value <= 1
    assert np.abs(errors).mean() < 0.04 and abs(np.mean(errors)) < 0.02
    same = fingerprint.fingerprints(spark.createDataFrame([(1, "A b c d e f"), (2, "a b  c d e f"), (3, None), (4, "")], "doc_id long, text string")).toPandas()["fingerprint"]
    assert same[0] == same[1] and same[2] == same[3] != same[0] and len(same[0]) == fingerprint.BINS * fingerprint.BITS // 4


def test_fingerprint_edges(spark, odd):
    out = fingerprint.compared(odd).toPandas()
    assert len(out) == 9 and out["fingerprint"].notna().all() and out["near_next"].between(0, 1).all()
    assert fingerprint.compared(odd.limit(0)).count() == 0
    one = fingerprint.compared(spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    many = spark.createDataFrame([(i, f"t{i} x") for i in range(5000)], "doc_id long, text string")
    following = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(many).select("doc_id", "next_text").collect()}
    assert len(following) == 5000 and all(following[i] == f"t{(i - 1) % 5000} x" for i in range(5000))


# ------------------------------------------------------------------ op3


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def near_corpus(seed, n=40):
    """Chains of edits, copies, shared passages and short texts."""
    rng = np.random.default_rng(seed)
    passage = prose(rng, 60)
    texts = []
    for _ in range(n):
        base = prose(rng, int(rng.integers(3, 120)))
        texts.append(base)
        now = base
        for _ in range(int(rng.integers(0, 4))):
            now = edit(rng, now, max(1, len(now.split()) // 60)) if len(now.split()) > 20 else now + " x"
            texts.append(now)
        texts += [base] * int(rng.integers(0, 3)) + ([passage + " " + prose(rng, int(rng.integers(1, 40)))] if rng.random() < 0.6 else [])
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,hot_least", [(0, 64), (1, 4), (2, 2)])
def test_jaccard_components_are_exact(spark, monkeypatch, seed, hot_least):
    """With a low bar for frequent tokens, their combinations carry the join."""
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", hot_least)
    rows = near_corpus(seed)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


@pytest.mark.parametrize("hot_least", [64, 3])
def test_large_group_of_near_copies(spark, monkeypatch, hot_least):
    """A group whose members are mostly too far from each other, compared in blocks."""
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", hot_least)
    rng = np.random.default_rng(5)
    base = " ".join(f"b{i}" for i in range(140))
    rows = [(i, edit(rng, base, int(rng.integers(0, 9)))) for i in range(150)] + [(1000 + i, base) for i in range(30)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))


@pytest.mark.parametrize("seed,hot_least", [(3, 64), (4, 3)])
def test_links_are_complete(spark, monkeypatch, seed, hot_least):
    """All links between different sets, and each document's number of links, against all pairs."""
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", hot_least)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 300)
    rng = np.random.default_rng(seed)
    base = " ".join(f"b{i}" for i in range(90))
    rows = near_corpus(seed) + [(1000 + i, edit(rng, base, int(rng.integers(0, 5)))) for i in range(40)] + [(2000, None), (2001, " "), (2002, base), (2002, base)]
    classes, pairs = jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets = [shingles(t) for _, t in rows]
    linked = [[bool(x and y) and 100 * len(x & y) >= 75 * len(x | y) for y in sets] for x in sets]
    want = sorted((key, len(x), sum(own) - bool(x)) for (key, _), x, own in zip(rows, sets, linked, strict=True))
    got = classes.collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["links"]) for r in got) == want
    names = {r["doc_id"]: r["set_id"] for r in got}
    distinct = {tuple(sorted((names[rows[i][0]], names[rows[j][0]]))) for i in range(len(rows)) for j in range(i) if linked[i][j] and sets[i] != sets[j]}
    found = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == distinct
    empty, none = jaccard_join.links(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == none.count() == 0


def test_frequent_tokens_are_counted_over_batches(spark, monkeypatch):
    """A token that each batch holds once is counted."""
    monkeypatch.setattr(shared, "BATCH_ROWS", 10)
    rng = np.random.default_rng(9)
    rows = [(i, "one very common passage here " + prose(rng, 12, 10**6)) for i in range(1, 200)]
    every_tenth = [(i, t if i % 10 == 0 else prose(rng, 17, 10**6)) for i, t in rows]
    frame = spark.createDataFrame(every_tenth, "doc_id long, text string").coalesce(1)
    _, heavy = jaccard_join.document_sets(frame)
    assert heavy.groupBy("token").sum("hits").agg(F.max("sum(hits)")).first()[0] == 19


def test_frequent_prefix_proves_links():
    """Any two linked sets of frequent tokens share a combination of their prefixes."""
    rng = np.random.default_rng(0)
    for _ in range(3000):
        n = int(rng.integers(3, 60))
        x = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        drop = rng.random(len(x)) < rng.random() * 0.3
        y = np.unique(np.concatenate([x[~drop], rng.integers(0, 1 << 60, int(rng.integers(0, 1 + len(x) // 4)), dtype=np.uint64)]))
        common, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if 100 * common >= 75 * union and not np.array_equal(x, y):
            a, b = (set(jaccard_join._frequent_prefix(s, len(s), 0, 75, 100).tolist()) for s in (x, y))
            assert a & b


def test_jaccard_edges(spark, odd):
    got = jaccard_join.jaccard_components(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows), key=key)
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0
    assert jaccard_join.jaccard_components(odd.where("doc_id IN (2, 3, 4)")).count() == 3
    kept = jaccard_join.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert jaccard_join.distinct_documents(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(odd, (0, 100))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 0 and got[201] == got[200] == 200 and 300 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ op4, op6


def languages(rng, n):
    words = {"aa": ["the", "and", "thing", "with", "shell"], "bb": ["der", "und", "schein", "für", "nicht"], "cc": ["el", "que", "ción", "los", "año"], "dd": ["le", "être", "eaux", "dans", "pour"]}
    rows = []
    for i in range(n):
        lang = sorted(words)[i % 4]
        rows.append((i, " ".join(rng.choice(words[lang], int(rng.integers(2, 30)))), lang, "s", 0))
    return rows


def test_language_id(spark):
    rows = languages(np.random.default_rng(3), 400)
    docs = spark.createDataFrame(rows, DOC)
    got = langid.identified(docs).toPandas().set_index("doc_id")
    for key, _, lang, *_ in rows:
        assert got.loc[key, "held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0)
    held = got[got["held_out"]]
    truth = pd.Series({r[0]: r[2] for r in rows})
    assert (held["lang_pred"] == truth[held.index]).mean() > 0.97 and held["score"].between(0, 1).all()
    assert len(langid.codewords(4)[0]) == 7 and len(langid.codewords(20)) == 20
    assert min((a != b).sum() for i, a in enumerate(langid.codewords(20)) for b in langid.codewords(20)[:i]) >= 10


def test_language_edges(spark, odd):
    got = langid.identified(odd).select("doc_id", "lang_pred", "score").collect()
    assert len(got) == 9 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4, 7))
    assert langid.identified(odd.limit(0)).count() == 0
    nothing = langid.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    one = langid.identified(odd.withColumn("lang", F.lit("xx"))).where("doc_id = 1").first()
    assert (one["lang_pred"], one["score"]) == ("xx", 1.0)
    assert langid.recognised(odd, langid.fit(odd)).columns == odd.columns


def test_language_of_many(spark):
    """Every language is learnt, however many there are, and whatever the length of its texts."""
    rng = np.random.default_rng(13)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    alphabets = [rng.choice(letters, 9, replace=False) for _ in range(230)]
    rows = []
    for i in range(230 * 14):
        own = alphabets[i % 230]
        text = " ".join("".join(rng.choice(own, int(rng.integers(3, 8)))) for _ in range(40))
        rows.append((i, text * (300 if i % 230 == 7 else 1), f"lang{i % 230}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identified(docs).toPandas().set_index("doc_id")
    held = got[got["held_out"]]
    truth = pd.Series({r[0]: r[2] for r in rows})[held.index]
    assert len(set(got["lang_pred"])) == 230 and (held["lang_pred"] == truth).mean() > 0.9


def test_language_losses_against_plain_formula():
    rng = np.random.default_rng(14)
    model = langid.Model([str(i) for i in range(9)], langid.codewords(9))
    bits = model.code.shape[1]
    model.weights, model.bias, model.trust = rng.normal(size=(2 * langid.BUCKETS, bits)), rng.normal(size=bits), rng.random(bits)
    x = rng.random((5, 2 * langid.BUCKETS)) / 30
    want = [[sum(model.trust[b] * np.log1p(np.exp(-model.code[k, b] * (x[i] @ model.weights[:, b] + model.bias[b]))) for b in range(bits)) for k in range(9)] for i in range(5)]
    assert np.allclose(model.losses(x), want, rtol=1e-4)
    best, score, _ = model.predict(x)
    assert best.tolist() == np.argmin(want, axis=1).tolist() and ((score > 0) & (score <= 1)).all()


def test_language_features_against_plain_counts():
    texts = ["The  cat, 9 éa", "", "x", "aab aab"]
    (_, buf, offs), = shared.text_chunks(pa.array(texts))
    got = langid.features(buf, offs)
    for text, row in zip(texts, got, strict=True):
        data = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode())
        data = re.sub(rb" +", b" ", b" " + data + b" ")
        for k, size in ((0, 2), (1, 3)):
            want = np.zeros(langid.BUCKETS)
            for i in range(len(data) - size + 1):
                want[((int.from_bytes(data[i : i + size], "big") * 2654435761) % (1 << 32)) >> 22] += 1
            want = np.sqrt(want / max(1, want.sum()))
            assert np.allclose(row[k * langid.BUCKETS : (k + 1) * langid.BUCKETS], want, atol=1e-6)


def test_sample_is_bounded_and_least(spark):
    frame = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"), F.xxhash64("id").alias("draw"))
    frame = frame.unionByName(frame.limit(500))
    counts = {r["key"]: (20, r["count"]) for r in frame.groupBy("key").count().collect()}
    got = langid.sampled(frame, "key", counts).toPandas()
    rows = frame.distinct().toPandas()
    rows["order"] = rows["draw"].to_numpy().astype(np.int64).view(np.uint64)
    want = rows.sort_values("order").groupby("key").head(20)
    assert set(zip(got["key"], got["draw"], strict=True)) == set(zip(want["key"], want["draw"], strict=True))


def toxic_rows(rng, n):
    rows = languages(rng, n)
    bad = ["moron", "idiota", "Dummkopf"]
    out, labels = [], []
    for i, r in enumerate(rows):
        toxic = int(rng.random() < 0.3)
        words = r[1].split(" ")
        if toxic:
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(bad)))
        out.append((r[0], " ".join(words), *r[2:]))
        labels.append((r[0], 1, toxic))
    return out, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(np.random.default_rng(4), 600)
    docs, table = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, table).toPandas().set_index("doc_id")
    held = got[got["held_out"]]
    truth = pd.Series({k: t for k, _, t in labels})[held.index]
    assert (held["predicted"] == truth).mean() > 0.97 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    model = toxicity.fit(docs, table)
    assert toxicity.clean(docs, model).columns == docs.columns


def test_toxicity_scores_against_plain_formula(spark):
    rows, labels = toxic_rows(np.random.default_rng(6), 300)
    model = toxicity.fit(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    table = model.table()
    assert len(table[0]) == (1 << toxicity.ROW_BITS) + 1 and not table[1][0].any()
    texts = ["the moron and", "", "moron", "and " * 50 + "Dummkopf", "unseen words here", "12 !!"]

    def logit(text):
        words = re.findall(r"[a-z\x80-\U0010ffff]+", lower(text))
        vectors = [table[1][table[0][int(toxicity.rows_of(np.array([lm_hash(w)], np.uint64))[0])]] for w in words]
        total, tap = model.intercept, 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                own = [max(0.0, model.bias[k * toxicity.FILTERS + f] + sum(float(vectors[i + j] @ model.filters[:, (tap + j) * toxicity.FILTERS + f]) for j in range(width) if i + j < len(vectors))) for i in range(len(vectors))]
                total += max(own, default=0.0) * model.out[k * toxicity.FILTERS + f]
            tap += width
        return total

    for _, buf, offs in shared.text_chunks(pa.array(texts)):
        hashes, first = toxicity.chunk_hashes(buf, offs)
        got = model.logits(table, *toxicity.padded(toxicity.rows_of(hashes), first))
    assert np.allclose(got, [logit(t) for t in texts], atol=1e-3)
    toxicity.STRETCH, whole = 8, toxicity.STRETCH
    assert np.array_equal(got, model.logits(table, *toxicity.padded(toxicity.rows_of(hashes), first)))
    toxicity.STRETCH = whole
    assert 0 < len(model.rows) < 200


def test_toxicity_of_long_texts(spark):
    """A class whose texts are all long is learnt."""
    rng = np.random.default_rng(15)
    rows = [(i, " ".join(rng.choice(["some", "plain", "words"], 15_000 if i % 2 else 20)) + (" moron " if i % 2 else " fine "), "aa", "s", 0) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(spark.createDataFrame(rows, DOC), labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Many shards: all documents with a label train or calibrate, and the averaged model tells them apart."""
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 300)
    rows, labels = toxic_rows(np.random.default_rng(4), 1500)
    docs, table = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels[:1400], "doc_id long, quality int, toxic int")
    seen = []
    cut = toxicity._shards
    monkeypatch.setattr(toxicity, "_shards", lambda *given: seen.append(cut(*given)) or seen[0])
    model = toxicity.fit(docs, table)
    got = seen[0].toPandas()
    assert len(got) == 5 and got["toxic"].map(len).sum() == 1400 and got["toxic"].map(sum).sum() == sum(t for _, _, t in labels[:1400])
    assert sum(toxicity._measured(seen[0], model, a)["n"].to_numpy().sum() for a in (False, True)) == 1400
    found = toxicity.predict(docs, model).toPandas().set_index("doc_id")["predicted"]
    assert (found[[k for k, _, _ in labels]].to_numpy() == [t for _, _, t in labels]).mean() > 0.97


def test_toxicity_cut_of_counts_is_that_of_rows():
    rng = np.random.default_rng(2)
    z, y, n = np.round(rng.normal(0, 1, 300), 1), rng.integers(0, 2, 300), rng.integers(1, 5, 300)
    assert toxicity._best_cut(z, y, n) == toxicity._best_cut(np.repeat(z, n), np.repeat(y, n))


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (4, None, None), (None, 1, 1), (5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd, labels).count() == 9
    assert toxicity.scored(odd.limit(0), labels).count() == 0
    alike = toxicity.scored(odd, labels.limit(0)).collect()
    assert len({r["score"] for r in alike}) == 1 and {r["predicted"] for r in alike} == {0}


# ------------------------------------------------------------------ op5


def test_bpe_equals_the_tokenizers_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = np.random.default_rng(6)
    alphabet = list("aabehinrt  sS'\n\té漢🙂½²٣12!.,  \x1c\x85") + ["'re", "<|endoftext|>", "  ", "ing"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 40)))) for _ in range(2000)] + ["a" * 500, " " * 300, "=" * 200, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame, BPE).collect()}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == e.ids and got[i]["n_tokens"] == len(e.ids)
        assert got[i]["decoded"] == library.decode(e.ids, skip_special_tokens=False)
    edges = bpe.digests(odd, BPE).collect()
    assert len(edges) == 9 and {r["n_tokens"] for r in edges if r["doc_id"] in (2, 3)} == {0}
    assert bpe.digests(odd.limit(0), BPE).count() == 0
    assert bpe.encode(odd, BPE).count() == 9


def test_automaton_accepts_only_what_bpe_makes():
    with open(BPE, "rb") as f:
        automaton = bpe.compiled(f.read())
    tokens = automaton.run(" internationalisation".encode())
    assert automaton.accepts(tokens) and b"".join(automaton.labels[t] for t in tokens) == b" internationalisation"
    split = [automaton.bytes_ids[b] for b in b" the"]
    assert not automaton.accepts(split)
    assert automaton.run(b"") == []


# ------------------------------------------------------------------ op7


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><p>Welcome to our site, the best, in town.</p></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, please accept them, or not.</p></div>
<div id="wrap"><div class="sidebar"><p>Some long text of a sidebar, with commas, that goes on for a while.</p></div>
<div class="post"><h2>Title here</h2><p>First paragraph of the article, it is long enough. It has&nbsp;two sentences.<p>Second, <b>bo</b>ld &amp; more
text here, and commas, and even more words.</p><ul><li>item one</li></ul><form>Name <input><button>Go</button></form><script>var x = "<p>no</p>";</script></div>
<section id="comments"><div class="comment"><p>I am a reader, I disagree with this in a long sentence, you know.</p></div></section></div><footer>&copy; us</footer></body></html>"""


def test_html_extraction(spark):
    assert html_extract.main_text(PAGE) == "Title here First paragraph of the article, it is long enough. It has two sentences. Second, bold & more text here, and commas, and even more words. item one"
    assert html_extract.main_text("<body><div class=ad>Buy, buy, buy this.</div><article><p>Short.</p></article><footer>c 2020, all rights, reserved.</footer></body>") == "Short."
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (5, "u", "<article><p>" + "long, text. " * 50_000 + "</p></article>"), (5, "u", "a < b & c, no tags at all, just some text."), (6, "u", "<div" * 500), (7, "u", "<!-- <article><p>no, no, no.</p></article>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_extract.extract(frame).collect()
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = {r["n_chars"] for r in got if r["page_id"] in (2, 3, 7, None)}
    assert texts == {0}
    assert max(r["n_chars"] for r in got) == 12 * 50_000 - 1
    assert html_extract.extract(frame.limit(0)).count() == 0


ARTICLE = ("This is a long article of prose, with many words and marks. " * 7)[:395].strip()


@pytest.mark.parametrize("around", ["<div>%s</div>", "<div class='sidebar-layout'>%s</div>", "<div id='legal'>%s</div>", "<div class='status page'>%s</div>", "<form id='aspnet'><div>%s</div></form>", "<article aria-label='Social media and search'>%s</article>", "<div data-id='comment 7'>%s</div>", "<div title='a hidden gem'>%s</div>"])
def test_html_names_do_not_veto(around):
    assert html_extract.main_text(around % f"<p>{ARTICLE}</p>") == ARTICLE
    parts = ["A title", ARTICLE[:200].strip(), ARTICLE[200:].strip(), "short item", "And."]
    inner = f"<h1>{parts[0]}</h1><p>{parts[1]}</p><p>{parts[2]}<ul><li>{parts[3]}</ul><p>{parts[4]}"
    page = f"<body><nav><a href=x>Home</a> <a href=y>News</a></nav><p hidden>{ARTICLE[:80]}</p>{around % inner}<div class=comments><p>{ARTICLE[:150]}</p></div><div class='ad'>Buy. Now. Cheap.</div><footer>Copyright, us.</footer></body>"
    assert html_extract.main_text(page) == " ".join(parts)


def test_html_reading_is_linear():
    began = time.process_time()
    for page in ('<a "' * 250_000, '<a b="' * 200_000 + ">", "<a b='x c=\"" * 90_000 + ">", "<div>x y" * 50_000, "<b>" * 50_000 + "<div>t</div>" * 20_000, "<i>" * 30_000 + "</u></b>" * 30_000, "<ul><li>x" * 20_000, "< " * 300_000, "<script>" * 50_000, "<!-- " * 90_000):
        html_extract.main_text(page)
    assert time.process_time() - began < 30


def test_html_scores_against_plain_ratios():
    rng = np.random.default_rng(17)
    tags = ["div", "p", "section", "h2", "li"]
    for _ in range(20):
        html, open_tags = "", []
        for _ in range(60):
            if open_tags and rng.random() < 0.5:
                html += f"</{open_tags.pop()}>"
            else:
                open_tags.append(str(rng.choice(tags[::2])))
                html += f"<{open_tags[-1]}>"
            words = " ".join("word" + "." * int(rng.integers(0, 2)) for _ in range(int(rng.integers(0, 30))))
            html += words if rng.random() < 0.7 else f"<a href=x>{words}</a> tail"
        page = html_extract.read(html)
        names, free = [], []
        for e in page.element:
            path = []
            while e:
                path.append(page.tag[e])
                e = page.parent[e]
            names.append("/".join(reversed(path)))
        ratio = {}
        for name in set(names):
            own = [i for i, x in enumerate(names) if x == name]
            chars = sum(len(page.texts[i]) for i in own)
            prose = 1 - sum(page.linked[i] for i in own) / chars
            ratio[name] = (chars / len(own) * prose, (1 + sum(page.texts[i].count(".") for i in own) / len(own)) * prose, prose)
        kernel = [np.exp(-0.5 * (d / html_extract.SIGMA) ** 2) for d in range(-3, 4)]
        smooth = [[sum(k * ratio[names[min(max(i + d, 0), len(names) - 1)]][s] for d, k in zip(range(-3, 4), kernel, strict=True)) / sum(kernel) for i in range(len(names))] for s in (0, 1)]
        fused = [np.sqrt(smooth[0][i] * smooth[1][i] * ratio[x][2]) for i, x in enumerate(names)]
        want = [np.mean([fused[j] for j, y in enumerate(names) if y == x]) for x in names]
        assert np.allclose(html_extract.path_scores(page)[0], want)


# ------------------------------------------------------------------ op8


def test_short_text_beside_long_paragraphs_stays():
    """Inside the article the length of a block decides nothing: only names and links take something out."""
    lead = "This sentence is one of very many, and it says little. " * 80
    short = "".join(f"<p>Short paragraph number {i}.</p>" for i in range(20))
    page = f"<body><nav><a href=/>home</a></nav><div><p>{lead}</p>{short}</div><footer>imprint</footer></body>"
    got = html_extract.main_text(page)
    assert all(f"number {i}." in got for i in range(20)) and "home" not in got and "imprint" not in got
    got = html_extract.main_text(f"<body><article><h2>Head</h2><p>{lead * 2}</p><div class=share-buttons>Share this</div></article></body>")
    assert got.startswith("Head This sentence") and "Share" not in got
    menu = "<ul><li><a href=1>first linked</a></li><li><a href=2>second linked</a></li></ul>"
    got = html_extract.main_text(f"<body><article><p>{lead}</p><ul><li>a plain item</li><li>one with <a href=3>a link</a></li></ul></article>{menu}</body>")
    assert got.endswith("a plain item one with a link")



def test_chat_round_trip(spark):
    texts = ["", "plain", r"back\slash \\ \<| x", "<|im_start|>user\nno<|im_end|>\n", "</s>[INST] ok [/INST]<s>", "line\nline\n", "\\", "<<SYS>> a <</SYS>>", "<|im_end|>", "ends with \\"]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant"] * 5, np.roll(texts, c), strict=True))]
    rows = [(c, t, r, str(x)) for c, t, r, x in rows] + [(9, 1, None, None), (9, None, "assistant", "first"), (9, 1, None, None), (None, 0, "user", "hi")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    rendered = chat.render(chat.fold(chat.events(frame)))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse(rendered).collect()}
    for c in range(3):
        assert back[c] == [(r, x) for k, _, r, x in rows if k == c]
    assert back[9] == [("assistant", "first"), ("", ""), ("", "")] and back[None] == [("user", "hi")]
    digests = {r["conv_id"]: r for r in chat.digests(chat.parse(rendered)).collect()}
    for c in range(3):
        own = back[c]
        loss = "".join(x for r, x in own if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for r, x in own)
        d = digests[c]
        assert (d["n_turns"], d["loss_chars"]) == (10, len(loss)) and d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and d["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    for r in rendered.collect():
        assert d["formatted_chars"] == len({x["conv_id"]: x["formatted"] for x in rendered.collect()}[2])
        inside = r["formatted"].split("<|im_start|>")
        assert r["formatted"].count("<|im_start|>") >= len(inside) - 1
    assert chat.fold(chat.events(frame.limit(0))).count() == 0


def test_chat_rows_are_folded(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, "assistant", None), (1, 1, None, "z"), (1, None, "user", "first"), (None, 2, "user", ""), (2, 10, "a", "b"), (2, 9, "a", "c")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["seq"], t["role"], t["text"]) for t in r["turns"]] for r in chat.fold(chat.events(frame)).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert got == want and len(got[1]) == 6
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    folded = []
    fold = chat.fold
    monkeypatch.setattr(chat, "fold", lambda log: folded.append(log) or fold(log))
    got = {r["conv_id"]: r["n_turns"] for r in queries.QUERIES["op8_chat_formatting"](spark, str(tmp_path)).collect()}
    assert len(folded) == 1 and got == {1: 6, None: 1, 2: 2, -1: 2}


def test_chat_roles_with_line_feeds(spark):
    roles = ["assistant\nx", "assistant", "\n", "a\\", "a\\\nb", "\\l", "\\\\l\n\\", "<|im_start|>user\n", "x\n<|im_end|>\n<|im_start|>assistant", "</s>\n\n[INST]"]
    rows = [(c, t, r, f"said {t}\n") for c in range(2) for t, r in enumerate(roles[::-1] if c else roles)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parsed = chat.parse(chat.render(chat.fold(chat.events(frame))))
    back = {r["conv_id"]: [(t["role"], t["text"], t["loss"]) for t in r["turns"]] for r in parsed.collect()}
    assert back == {k: [(r, x, r == "assistant") for c, _, r, x in rows if c == k] for k in range(2)}


def test_chat_fold_against_plain_replay(spark):
    rng = np.random.default_rng(12)
    log = []
    for conv in range(6):
        for seq in range(400):
            kind = str(rng.choice(["delta", "delta", "delta", "edit", "regenerate", "message"]))
            log.append((conv, seq, f"m{int(rng.integers(5))}", kind, None if rng.random() < 0.5 else f"r{int(rng.integers(3))}", None if rng.random() < 0.1 else f"t{seq} "))
    log += [(9, i, "long", "delta" if i else "message", "assistant", "x" * 50) for i in range(20_000)]
    want, order = {}, {}
    for conv, seq, msg, kind, role, text in sorted(log, key=lambda e: e[:2]):
        order.setdefault(conv, []).append(msg) if msg not in order.get(conv, []) else None
        had_role, had = want.get((conv, msg), (None, ""))
        want[conv, msg] = (had_role or role, had + (text or "") if kind == "delta" else text or "")
    events = spark.createDataFrame([log[i] for i in rng.permutation(len(log))], "conv_id long, seq long, msg string, kind string, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.fold(events).collect()}
    assert got == {c: [(want[c, m][0] or "", want[c, m][1]) for m in ms] for c, ms in order.items()}
    assert len(got[9][0][1]) == 50 * 20_000


def test_chat_events(spark):
    log = [(1, 1, "a", "message", "user", "hi"), (1, 2, "b", "delta", "assistant", "he"), (1, 3, "b", "delta", None, "llo"), (1, 5, "a", "edit", None, "hi there"), (1, 6, "b", "regenerate", None, ""), (1, 7, "b", "delta", None, "good "), (1, 8, "b", "delta", None, "day"), (2, 1, "a", None, None, None)]
    events = spark.createDataFrame(log[::-1], "conv_id long, seq long, msg string, kind string, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.fold(events).collect()}
    assert got == {1: [("user", "hi there"), ("assistant", "good day")], 2: [("", "")]}
    assert chat.render(chat.fold(events)).count() == 2
    with pytest.raises(Exception, match="unknown event"):
        chat.fold(events.withColumn("kind", F.lit("typo"))).collect()


# ------------------------------------------------------------------ op9


def brute_neighbours(rows, asked, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for q, x in good:
        if q in asked and q not in out:
            near = sorted((float(ann.exact(x, v[None])[0]), i) for i, v in good if i != q)[:k]
            out[q] = [(i, s) for s, i in near]
    return out


def test_neighbours_recall_and_bounds(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.5 * rng.normal(size=24)).tolist()) for i in range(900)] + [(5000 + i, [1.0] * 24) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = {i for i, _ in rows if i % 50 == 0}
    got = ann.search(frame, frame.where("vec_id % 50 = 0")).toPandas()
    want = brute_neighbours(rows, asked)
    hits = total = 0
    for q, near in want.items():
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11))
        found = dict(zip(own["vec_id"], own["score"], strict=True))
        hits += sum(found.get(i) == s for i, s in near)
        total += len(near)
    assert hits / total >= 0.99
    index = ann.Index(np.zeros(24))
    x, q = rng.normal(size=(2000, 24)), rng.normal(size=24)
    guess, least = index.bounds(q, *index.encode(x))
    true = ((x - q) ** 2).sum(1)
    assert (least <= true + 1e-9).mean() > 0.995 and np.corrcoef(guess, true)[0, 1] > 0.8


def test_neighbour_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 2.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "code": F.lit(2)})
    got = [tuple(r) for r in ann.search(frame, frame.where("vec_id % 2 = 0")).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 7, 0.0), (0, 2, 9, 0.0), (0, 3, 6, np.sqrt(5))]
    assert {g[0] for g in got} == {0, 6} and [g[2] for g in got if g[0] == 6] == [0, 0, 7, 9]
    assert ann.search(frame.limit(0), frame).count() == 0 and ann.search(frame, frame.limit(0)).count() == 0
    assert ann.search(frame.where("vec_id = 6"), frame.where("vec_id = 6")).count() == 0


# ------------------------------------------------------------------ op10


def lm_hash(word):
    return int(lm_score.everything(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0][0])


def test_lm_scores(spark):
    rng = np.random.default_rng(10)
    cycle = ["red", "blue", "green", "grey"]
    texts = [" ".join(cycle[(s + i) % 4] for i in range(int(n))) for s, n in zip(rng.integers(0, 4, 300), rng.integers(5, 400, 300), strict=True)]
    docs = spark.createDataFrame(list(enumerate(texts * 8)), "doc_id long, text string")
    model = lm_score.fit(docs)
    shuffled = " ".join(rng.permutation(texts[0].split() * 3))
    trial = spark.createDataFrame([(0, " ".join(cycle * 20)), (1, shuffled), (2, "quick zebra jumps " * 20), (3, None), (4, " \t "), (5, " ".join(cycle * 20)), (None, "red")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_score.score(trial, model).collect()}
    assert got[0]["mean_log_prob"] > got[1]["mean_log_prob"] + 0.5 > got[2]["mean_log_prob"]
    assert got[0]["log_prob"] == pytest.approx(got[5]["log_prob"]) and got[0]["n_tokens"] == 80
    assert (got[3]["n_tokens"], got[3]["log_prob"], got[3]["perplexity"]) == (0, 0.0, None) and got[4]["n_tokens"] == 0
    assert got[0]["perplexity"] == pytest.approx(np.exp(-got[0]["mean_log_prob"]))


def lm_network(outputs, seed=2):
    rng = np.random.default_rng(seed)
    net = lm_score.Network.fresh(rng.integers(1, 1000, outputs + lm_score.RARE).astype(float))
    for p in net.params:
        p += rng.normal(0, 0.2, p.shape).astype(np.float32)
    net.params[0][:, net.pad] = 0
    return net


@pytest.mark.parametrize("outputs", [0, 5, 60, 700])
def test_lm_probabilities_add_up(outputs):
    net = lm_network(outputs)
    total = 0.0
    for word in range(net.pad):  # every output between the same neighbours
        line = np.array([net.pad, net.pad, 0, word, min(3, net.pad - 1), net.pad, net.pad], np.uint16)
        total += np.exp(float(net.log_probabilities(line)[3]))
    assert total == pytest.approx(1.0, abs=1e-4)


def test_lm_network_against_plain_formula():
    """A step's gradient and the log probabilities against loops over single windows."""
    net = lm_network(200)
    rng = np.random.default_rng(4)
    line, place = lm_score.line_of(rng.integers(0, net.pad, 60).astype(np.uint16), np.array([0, 25, 25, 60]), net.pad)

    def exponential(x):
        return np.array([np.float32(x * lm_score._UNIT + lm_score._ZERO)], np.float32).astype(np.int32).view(np.float32)[0]

    def log_probability(i):
        h = net.params[1].astype(np.float64)
        for p, o in enumerate((-2, -1, 1, 2)):
            h = h + net.params[0][p, line[i + o]]
        h = np.append(np.maximum(h, 0), 1)
        logs = 0.0
        head = int(net.head[line[i]])
        for w, own in [(net.params[2], head)] + [(w, int(line[i]) - a) for w, (a, b) in zip(net.params[3:], net.clusters, strict=True) if a <= line[i] < b]:
            weights = np.array([exponential(x) for x in h @ w])
            logs += np.log(weights[own] / weights.sum())
        return logs

    got = net.log_probabilities(line)
    assert len(place) == 60 and [line[i] == net.pad for i in range(len(line)) if i not in set(place)] == [True] * (len(line) - 60)
    for i in place:
        assert got[i] == pytest.approx(log_probability(int(i)), abs=1e-3)
    losses = [net.step(line, 2, len(line) - 2)[0] for _ in range(40)]
    assert losses[-1] < losses[0] / 2
    again = lm_score.Network.unflat(net.flat(), 200)
    assert np.array_equal(again.log_probabilities(line), net.log_probabilities(line))


def test_lm_edges(spark, odd):
    counts = {r["word"]: r["n"] for r in lm_score.word_counts(odd.select("text")).collect()}
    words = [w for t in (r["text"] for r in odd.collect()) if t for w in re.findall(r"[^\W\d_]+|[^\x00-\x7f]+", t)]
    assert sum(counts.values()) >= 3 * 6 and len(words) > 0
    assert lm_score.score(odd, lm_score.fit(odd)).count() == 9
    empty = odd.limit(0)
    assert lm_score.score(empty, lm_score.fit(empty)).count() == 0
    assert lm_score.score(odd, lm_score.fit(empty)).where("log_prob IS NULL").count() == 0


@pytest.mark.parametrize("table", [1 << 20, 2100, 1000])
def test_lm_vocabulary_follows_the_corpus(spark, monkeypatch, table):
    monkeypatch.setattr(lm_score, "TABLE", table)
    monkeypatch.setattr(lm_score, "MOST", 1500)
    frequent, some, once = ([a + "".join(chr(97 + int(c)) for c in f"{i:04d}") for i in range(n)] for a, n in (("f", 2000), ("s", 3000), ("o", 3000)))
    docs = spark.createDataFrame(list(enumerate([" ".join(frequent)] * lm_score.LEAST + [" ".join(some)] * 9 + [" ".join(once)])), "doc_id long, text string")
    model = lm_score.fit(docs, rounds=1)
    vocabulary = model.vocabulary
    hashes = np.array([lm_hash(w) for w in frequent + some + once], np.uint64)
    ids, rare, shares = vocabulary(hashes)
    held = 0 if table == 1000 else 2000  # words of equal counts are in the driver's table or not together
    assert len(vocabulary.words) == held and vocabulary.outputs == min(held, 1500)
    assert sorted(ids[ids < vocabulary.outputs]) == list(range(vocabulary.outputs)) and set(rare) == set(np.flatnonzero(ids >= vocabulary.outputs))
    total = 2000 * lm_score.LEAST + 9 * 3000 + 3000
    assert vocabulary.mass.sum() == pytest.approx(total + lm_score.UNSEEN) and vocabulary.mass[-1] == pytest.approx(total - held * lm_score.LEAST + lm_score.UNSEEN)
    if held:
        kept = np.exp(shares[ids[rare] < vocabulary.pad - 1])
        assert len(kept) == 500 and kept.sum() == pytest.approx(1, abs=1e-4)
    # words beyond the table part the probability of their class by their counts; one that the corpus does not have gets the least
    trial = spark.createDataFrame([(w,) * 2 for w in (some[0], once[0], "u" + once[0])], "doc_id string, text string")
    got = {r["doc_id"][0]: r["log_prob"] for r in lm_score.score(trial, model).collect()}
    assert got["s"] - got["o"] == pytest.approx(np.log(9)) and got["o"] - got["u"] == pytest.approx(np.log(1 / lm_score.UNSEEN))


def test_lm_trains_on_every_position(spark, monkeypatch):
    texts = ["one", "two words", None, "", " ".join(["many", "more", "words"] * 100)] * 7
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    assert lm_score.fit(docs).trained == 7 * 303
    monkeypatch.setattr(shared, "CHUNK_BYTES", 1000)  # many chunks, dealt over the rounds
    net, line = lm_network(20), np.full(50, 20 + lm_score.RARE, np.uint16)
    line[3:40] = 7
    assert sum(net.step(line, a, min(a + 10, 48))[1] for a in range(2, 48, 10)) == 37


def test_lm_query_drops_no_token(spark, odd, tmp_path):
    texts = [r["text"] for r in odd.select("text").collect()] + ["4734663219866878$$$ ### %%%", "È$$$ onai*** a1b2\x00"]
    odd.select("doc_id", "text").union(spark.createDataFrame([(8, texts[-2]), (9, texts[-1])], "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[7] == 6 and got[8] == 10 and got[9] == 13
    buf = pa.array(texts, pa.large_string())
    for _, data, offs in shared.text_chunks(buf):
        hashes, first = lm_score.everything(data, offs)
        want = [re.findall(r"[a-z\x80-\U0010ffff]+|[0-9]+|[^\x20\x09-\x0D]", lower(x or "")) for x in texts]
        assert np.diff(first).tolist() == [len(w) for w in want] and len(set(hashes.tolist())) == len({x for w in want for x in w})
