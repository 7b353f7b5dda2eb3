r"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Every document of a source expects ``target / source_size`` copies.  In a fixed
order of the source's documents these are prefix-summed, one random offset is
added, and a document is emitted once for each integer that the sum crosses, so a
source of n documents gives floor or ceil of its expected number and the taken
words are near the target: the order runs through the sizes, so each stretch of
it is a sample of nearly equal ones.

The prefix sum never gathers a source in one task.  Documents are dealt into
chunks (source, class of size, salt); chunk counts are aggregated on the map side
and prefix-summed per source over at most some thousand chunks, and only within a
chunk are documents numbered.  A source with a third of all rows is split over
all its chunks; the number of salts follows its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.shared import cut

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its own size, no document more copies.
MOST = 3
#: What white space parts.
WORD = r"[^\x20\x09-\x0D]+"
#: Salts of a size class: this many, and as many again for each SALT_ROWS documents of the source.
SALTS, SALT_ROWS = 16, 4_000_000


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs) -> also rank, weight, target: the weighted shares of the whole, capped.

    A target stops at ``most`` times its source's size and the excess goes to the
    others by weight until none is above: sources by their cap for a unit of weight
    are capped as long as the level of the remaining ones lies above.  The table
    has a row for each source, so its windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"whole": F.sum("source_size").over(whole), "weights": F.sum("weight").over(whole), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    rows = rows.withColumn("capped", (F.col("whole") - F.col("cap_before")) * F.col("weight") > F.col("cap") * (F.col("weights") - F.col("weight_before")))
    rows = rows.withColumns({"rest": F.col("whole") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole), "rest_weight": F.col("weights") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(whole)})
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("rest").cast("double") * F.col("weight") / F.col("rest_weight"))
    return rows.select("source", "source_size", "n_docs", "rank", "weight", target.alias("target"))


def _random(column, digits: int):
    """A whole number of ``digits`` hexadecimal digits from a column's text (the same in any engine)."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken; one row per input row.

    size is the number of words (a null text has none), copies how often the
    mixture takes the document, taken = size * copies.  A source of no words has
    target 0 and gives no copies.  Null is a source of its own, the last.
    Documents of equal size are taken in order of a hash of their doc_id; repeated
    rows count each.  Reruns agree.  An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select("doc_id", "source", size.alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = shares(sizes, weights, most)
    offset = _random(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit(""))), 5) / F.lit(float(1 << 20))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(F.col("source").alias("of"), "source_size", "target", "rank", rate.alias("rate"), offset.alias("offset"), (F.lit(SALTS) * (1 + F.expr(f"n_docs div {SALT_ROWS}"))).alias("salts"))
    digits = "length(string(size))"
    chunk = F.expr(f"{digits} * 100 + size div cast(pow(10, greatest({digits} - 2, 0)) AS bigint)").cast("long")
    dealt = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("random", _random(F.col("doc_id"), 15))
    dealt = dealt.withColumns({"chunk": chunk, "salt": F.col("random") % F.col("salts")})
    key = ["rank", "chunk", "salt"]
    counts = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("rank").orderBy("chunk", "salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*key, F.coalesce(ahead, F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("size", "random", "doc_id"))
    placed = dealt.join(counts, key).withColumn("place", (F.col("ahead") + place).cast("double"))
    crossed = F.floor(F.col("place") * F.col("rate") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("rate") + F.col("offset"))
    out = placed.withColumn("copies", crossed.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of the mixture: each row of ``docs`` as often as ``mixed`` (of ``mix``) says, all columns kept.

    Rows of equal doc_id, source and size are alike to ``mix``, which takes them in any order: they share the copies
    that it gave them, in order of a hash of the row.  Null and repeated doc_ids need no other care.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # a struct is never null, so rows with nulls meet; window and join share one shuffle of the texts
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mixed_row"), F.struct("doc_id", "source", size.alias("size")).alias("mixed_key"))
    own = own.withColumn("mixed_place", F.row_number().over(Window.partitionBy("mixed_key").orderBy(F.xxhash64("mixed_row"))))
    taken = mixed.groupBy(F.struct("doc_id", "source", "size").alias("mixed_key")).agg(F.sum("copies").alias("mixed_sum"), F.count(F.lit(1)).alias("mixed_rows")).where("mixed_sum > 0")
    copies = F.expr("cast(mixed_sum div mixed_rows + if(mixed_place <= mixed_sum % mixed_rows, 1, 0) as int)")
    joined = own.join(taken, "mixed_key").withColumn("mixed_copies", copies).where("mixed_copies > 0")
    return joined.withColumn("mixed_copy", F.explode(F.sequence(F.lit(1), F.col("mixed_copies")))).select("mixed_row.*")


#: DuckDB SQL of ``op1_mixing``.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk, {MOST} * source_size AS cap FROM s
), w AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][(rnk - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM r
), b AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS whole, (sum(weight) OVER ())::BIGINT AS weights,
    coalesce(sum(cap) OVER before, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER before, 0)::BIGINT AS weight_before FROM w
  WINDOW before AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, (whole - cap_before) * weight > cap * (weights - weight_before) AS capped FROM b),
e AS (
  SELECT *, whole - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::BIGINT AS rest,
    weights - (sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::BIGINT AS rest_weight FROM c
), t AS (
  SELECT source, source_size, rnk, n_docs, CASE WHEN capped THEN cap::DOUBLE ELSE rest::DOUBLE * weight / rest_weight END AS target,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM e
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT AS random, {SALTS} * (1 + t.n_docs // {SALT_ROWS}) AS salts,
    length(d.size::VARCHAR) * 100 + d.size // pow(10, greatest(length(d.size::VARCHAR) - 2, 0))::BIGINT AS chunk
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (SELECT *, row_number() OVER (PARTITION BY rnk ORDER BY chunk, random % salts, size, random, doc_id)::DOUBLE AS place FROM k)
SELECT doc_id, size, source_size, target, size * (floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT AS taken FROM p
"""
