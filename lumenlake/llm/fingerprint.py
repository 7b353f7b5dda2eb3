r"""Document fingerprints by one-permutation MinHash (DataFrame operations only).

A text's shingles (five words; the whole sequence if fewer) are hashed once.  The
high byte of a hash is its bin, and a bin holds its least hash.  Empty bins are
filled by optimal densification: each has its own random order of the bins and
copies the first one in it that is not empty, so that two texts choose alike and
independently of the other empty bins.  Of each bin the low ``BITS`` bits are
kept, packed into longs; equal low bits occur by chance with probability
``2**-BITS``, which the estimate takes back.

Everything happens inside a row: no shuffle and no group, a hash sort of the
document's own shingles.  Sentinels, one a bin, are sorted in with the hashes, so
the first value of each bin in the sorted array is its least hash or the sentinel
of an empty bin.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.shared import SHINGLE_WORDS

#: Bins of a fingerprint (a power of two up to 256) and bits kept of each.
BINS, BITS = 256, 8
#: Bins that an empty one asks in its drawn order, before the rest by hash order.
PROBES = 48
#: Rows of a bucket when documents are put in order, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 1000, 4096

_LOW = (1 << 56) - 1


def _let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _orders() -> str:
    """The first PROBES of each bin's random order of all bins, from a seeded rule, as a SQL constant."""
    draw = random.Random(20)
    return f"from_json('{json.dumps([draw.sample(range(BINS), PROBES) for _ in range(BINS)])}', 'array<array<int>>')"


def packed(text: str) -> str:
    """SQL of the fingerprint of the SQL string ``text``: BINS * BITS bits in an array of longs; null texts are empty."""
    k = SHINGLE_WORDS
    space = r"[\\x20\\x09-\\x0D]+"
    words = f"filter(split(lower(coalesce({text}, '')), '{space}'), w -> w <> '')"
    hashes = f"transform({words}, w -> xxhash64(w))"
    window = ", ".join(f"h[i + {j}]" for j in range(1, k))
    whole = "aggregate(h, 0L, (a, x) -> xxhash64(a, x))"
    shingles = f"CASE WHEN size(h) = 0 THEN array() WHEN size(h) < {k} THEN array({whole}) ELSE transform(slice(h, 1, size(h) - {k - 1}), (x, i) -> xxhash64(x, {window})) END"
    sentinels = f"transform(sequence(-128, 127), b -> shiftleft(cast(b AS bigint), 56) | {_LOW}L)"
    # 256 values in the order of their high byte; an empty bin's is all ones below it
    dense = _let(f"sort_array(concat(s, {sentinels}))", "o", "filter(o, (x, i) -> i = 0 OR shiftright(x, 56) <> shiftright(o[i - 1], 56))")
    is_empty = f"(x & {_LOW}L) = {_LOW}L"
    held = f"filter(transform(d, (x, i) -> CASE WHEN {is_empty} THEN -1 ELSE i END), i -> i >= 0)"
    lacking = f"filter(transform(d, (x, i) -> CASE WHEN {is_empty} THEN i ELSE -1 END), i -> i >= 0)"
    first = f"CASE WHEN size(held) <= {BINS // 2} THEN get(array_intersect(orders[i], held), 0) ELSE get(array_except(orders[i], lacking), 0) END"
    rest = "array_min(transform(held, j -> named_struct('r', xxhash64(i, j), 'j', j))).j"
    source = f"CASE WHEN NOT ({is_empty}) THEN i ELSE coalesce({first}, {rest}) END"
    values = f"CASE WHEN size(held) = 0 THEN transform(d, x -> 0L) WHEN size(held) = {BINS} THEN transform(d, x -> x & {(1 << BITS) - 1}) ELSE transform(d, (x, i) -> d[{source}] & {(1 << BITS) - 1}) END"
    each = 64 // BITS
    pack = " | ".join(f"shiftleft(v[q * {each} + {r}], {BITS * (each - 1 - r)})" for r in range(each))
    longs = f"transform(sequence(0, {BINS // each - 1}), q -> {pack})"
    body = _let(values, "v", longs)
    body = body.replace("orders[i]", f"{_orders()}[i]")
    body = _let(lacking, "lacking", body)
    body = _let(held, "held", body)
    body = _let(dense, "d", body)
    body = _let(shingles, "s", body)
    return _let(hashes, "h", body)


def text_form(longs: str):
    """A packed fingerprint as hexadecimal digits."""
    return F.array_join(F.transform(longs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str):
    """Estimated Jaccard likeness (0 to 1) of two packed fingerprints, corrected for chance matches."""
    ones = int(("0" * (BITS - 1) + "1") * (64 // BITS), 2)
    differ = f"transform(zip_with({a}, {b}, (p, q) -> p ^ q), x -> x | shiftrightunsigned(x, 4))"
    differ = f"transform({differ}, x -> x | shiftrightunsigned(x, 2))"
    differ = f"transform({differ}, x -> bit_count((x | shiftrightunsigned(x, 1)) & {ones}L))"
    chance = 1 / (1 << BITS)
    same = f"(1 - aggregate({differ}, 0, (t, n) -> t + n) / {float(BINS)}D)"
    return F.expr(f"least(1D, greatest(0D, ({same} - {chance!r}D) / {1 - chance!r}D))")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, fingerprint (hexadecimal), packed; one row per input row.

    Words are parted by ASCII white space and lower-cased.  Null, empty and blank
    texts have no shingles and the fingerprint of all zeros, alike only with each
    other.  Whole texts; equal texts have equal fingerprints; other columns are
    ignored and repeated rows kept.
    """
    return docs.select("doc_id", F.expr(packed("text")).alias("packed")).withColumn("fingerprint", text_form("packed"))


def _buckets(docs: DataFrame) -> tuple[str, list[int]]:
    """SQL of the bucket of a doc_id (0 for null), by cut points of equal counts over all documents.

    At most MOST_BUCKETS cut points come to the driver, however many documents there are.
    """
    n = docs.count()
    wanted = min(MOST_BUCKETS, max(1, math.ceil(n / BUCKET_ROWS)))
    cuts: list[int] = []
    if wanted > 1:
        shares = ", ".join(repr(i / wanted) for i in range(1, wanted))
        cuts = sorted({int(x) for x in docs.select(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10000, 8 * wanted)})").alias("c")).first()["c"] or []})
    step = max(1, math.isqrt(len(cuts)))
    coarse, fine = (f"from_json('{json.dumps(x)}', 'array<bigint>')" for x in (cuts[::step], cuts))
    if not cuts:
        return "CASE WHEN doc_id IS NULL THEN 0 ELSE 1 END", cuts
    # cut points at or below the id: first among every step-th one, then within the last stretch
    block = f"(size(filter({coarse}, c -> c <= doc_id)) - 1)"
    inside = f"CASE WHEN {block} < 0 THEN 0 ELSE {block} * {step} + size(filter(slice({fine}, greatest({block}, 0) * {step} + 1, {step}), c -> c <= doc_id)) END"
    return f"CASE WHEN doc_id IS NULL THEN 0 ELSE 1 + {inside} END", cuts


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, text, packed, next_text, next_packed: each row beside the one after it.

    The order is by descending doc_id, nulls last, equal ids by text; after the
    last row comes the first.  Texts shuffle once.  Documents are cut into buckets
    of about equal counts; a bucket's first rows also go to the bucket before it
    (as its last row's successor), so no task sees more than a bucket.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bucket, _ = _buckets(docs)
    firsts = docs.select("doc_id", F.expr(bucket).alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("first_id")).orderBy("bucket").collect()
    rows = docs.withColumn("bucket", F.expr(bucket))
    # the bucket that a bucket's first rows follow: the next higher one, or the lowest after the highest
    after = {r["bucket"]: firsts[(i + 1) % len(firsts)]["bucket"] for i, r in enumerate(firsts)}
    values = ", ".join(f"({r['bucket']}, {'CAST(NULL AS BIGINT)' if r['first_id'] is None else str(r['first_id']) + 'L'}, {after[r['bucket']]})" for r in firsts) or "(-1, 0L, -1)"
    edges = spark.sql(f"SELECT * FROM VALUES {values} AS t(edge_bucket, edge_id, edge_to)")
    rows = rows.join(F.broadcast(edges), (F.col("bucket") == F.col("edge_bucket")) & F.col("doc_id").eqNullSafe(F.col("edge_id")), "left")
    rows = rows.select("doc_id", "text", F.expr(packed("text")).alias("packed"), F.expr("CASE WHEN edge_to IS NULL THEN array(named_struct('b', bucket, 'ghost', 0)) ELSE array(named_struct('b', bucket, 'ghost', 0), named_struct('b', edge_to, 'ghost', 1)) END").alias("place"))
    rows = rows.select("doc_id", "text", "packed", F.explode("place").alias("place")).select("doc_id", "text", "packed", "place.b", "place.ghost")
    order = Window.partitionBy("b").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_packed": F.lead("packed").over(order)})
    return rows.where("ghost = 0").select("doc_id", "text", "packed", "next_text", "next_packed")


def compared(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document's (``with_next``).
    """
    rows = with_next(docs)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 AS int)), substring(next_text, 1, cast(n_chars div 3 AS int)))")
    rows = rows.select("doc_id", "n_chars", "packed", "next_packed", edited.alias("edited"))
    rows = rows.withColumn("edited_packed", F.expr(packed("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form("packed").alias("fingerprint"),
        text_form("edited_packed").alias("edited_fingerprint"),
        likeness("packed", "edited_packed").alias("near_edited"),
        likeness("packed", "next_packed").alias("near_next"),
    )
