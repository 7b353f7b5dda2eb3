"""Near duplicates by perceptual hashes, and groups of them.

``hamming_pairs`` finds all pairs of 64-bit hashes within a distance without
comparing all pairs: hashes that differ in at most k bits agree in one of k + 1
bands of bits, so an equi-join on (band, bits) has every such pair.  Bands are made
of bits in the order of their entropy, buckets that are still large are split by
further bits, and rows of one hash are joined as one.  Where the distance leaves so
few bits to a band that bands hardly part the hashes, blocks of hashes are compared
with blocks, each pair of blocks in a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.session import shared_dir, ship


def _stored(frame: DataFrame) -> tuple[DataFrame, str]:
    """``frame`` as a Parquet table in the shared folder, and its path."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def _dropped(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Distinct hashes that a bucket may hold before it is split by further bits.
MOST_IN_BUCKET = 256
#: Bands are used if all of them are expected to list at most this part of all pairs, and their splits have at most so many bands at a level (each is part of a plan).
BAND_SHARE, MOST_BANDS = 0.5, 512
#: Hashes of a block on average, hashes of one that are compared at once, and pairs of blocks of a task at most.
IN_BLOCK, AT_ONCE, BLOCKS_IN_TASK = 16_384, 128, 64


def bands(order: Sequence[int], distance: int) -> list[tuple[int, ...]]:
    """distance + 1 bands of bit positions: bits are dealt in turn, so each band has telling ones where ``order`` has them first."""
    n = distance + 1
    return [tuple(order[i::n]) for i in range(n)]


def bit_shares(hashes: DataFrame, value: str, bits: int) -> tuple[int, list[float]]:
    """The number of hashes, and of each bit the share that has it: one aggregate of a sum for each bit."""
    ones = hashes.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned(value, i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(bits)]).first()
    return ones["n"], [(ones[f"b{i}"] or 0) / (ones["n"] or 1) for i in range(bits)]


def _even_first(shares: Sequence[float]) -> list[int]:
    return sorted(range(len(shares)), key=lambda i: (round(abs(shares[i] - 0.5), 9), i))


def bit_order(hashes: DataFrame, value: str, bits: int) -> list[int]:
    """Positions of the bits, the most even ones first."""
    return _even_first(bit_shares(hashes, value, bits)[1])


def listed_share(shares: Sequence[float], order: Sequence[int], distance: int) -> float:
    """The part of all pairs that the bands list together, if bits were independent: two hashes agree in a bit of share p with p^2 + (1 - p)^2."""
    return sum(float(np.prod([shares[b] ** 2 + (1 - shares[b]) ** 2 for b in band])) for band in bands(order, distance))


def _mask(positions: Sequence[int]) -> int:
    m = sum(1 << p for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _along(path: tuple[int, ...], order: Sequence[int], distance: int) -> list[tuple[int, list[tuple[int, ...]]]]:
    """(band taken, bands to choose from) of each step of a path."""
    left, out = list(order), []
    for step in path:
        own = bands(left, distance)
        out.append((step, own))
        left = [b for b in left if b not in own[step]]
    return out


def _splits(path: tuple[int, ...], order: Sequence[int], distance: int) -> list[tuple[int, ...]] | None:
    """The bands of what a bucket's path leaves over; None if too few bits are left to split it."""
    used = {b for step, own in _along(path, order, distance) for b in own[step]}
    left = [b for b in order if b not in used]
    return bands(left, distance) if len(left) > distance + 1 else None


def _near_in_blocks(distinct: DataFrame, n: int, distance: int, in_block: int = IN_BLOCK) -> DataFrame:
    """h, g, hamming: each pair of different hashes of ``distinct`` within ``distance``, once, by comparing all pairs.

    Hashes are dealt into blocks by a hash of their own; a block meets itself and each
    other one in a join on their numbers, and a task compares AT_ONCE hashes with a
    block at a time.  The work is the square of the hashes' number, memory that of a block.
    """
    spark = distinct.sparkSession
    ship(spark)
    blocks = max(1, -(-n // in_block))
    pairs = blocks * (blocks + 1) // 2
    places = max(min(pairs, 4 * spark.sparkContext.defaultParallelism), -(-pairs // BLOCKS_IN_TASK))
    dealt = distinct.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("h").alias("own"))
    number = F.col("a") * blocks - F.expr("a * (a - 1) div 2") + F.col("b") - F.col("a")  # of the pair of blocks a <= b
    side = lambda a, b, name: dealt.select(a.alias("a"), b.alias("b"), F.col("own").alias(name)).select(number.cast("long").alias("pair"), "a", "b", name).repartition(places, "pair")
    others = lambda first, last: F.explode(F.sequence(F.lit(first) if isinstance(first, int) else first, F.lit(last) if isinstance(last, int) else last))
    met = side(F.col("block"), others(F.col("block"), blocks - 1), "x").join(side(others(0, F.col("block")), F.col("block"), "y").select("pair", "y"), "pair")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py() == batch.column(1)[i].as_py()
                x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                y = x if same else y  # a list that is made twice may have two orders
                for at in range(0, len(x), AT_ONCE):
                    part = x[at : at + AT_ONCE]
                    other = y[at:] if same else y
                    apart = np.bitwise_count((part[:, None] ^ other[None, :]).view(np.uint64))
                    first, second = np.nonzero(apart <= distance)
                    if same:
                        first, second = first[first < second], second[first < second]
                    yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(other[second]), pa.array(apart[first, second].astype(np.int32))], names=["h", "g", "hamming"])

    return met.select("a", "b", "x", "y").mapInArrow(run, "h long, g long, hamming int")


def _near_in_bands(distinct: DataFrame, order: Sequence[int], distance: int, most: int) -> DataFrame | None:
    """h, g, hamming: the pairs by bands of bits in ``order``; None if splits need more than MOST_BANDS bands at a level."""
    # a bucket: the path of bands to it (as text), the bits of the hash in them
    level = [((), bands(order, distance))]
    waiting, met = distinct.select("h", F.lit("").alias("at")), None
    while level:
        choice = F.lit(None).cast("array<struct<at:string,part:long,before:array<long>>>")
        for path, own in level:
            text = "".join(f"{p}." for p in path)
            fixed = _mask([b for q, s in _along(path, order, distance) for b in s[q]])
            made = F.array(*[F.struct(F.lit(f"{text}{i}.").alias("at"), F.col("h").bitwiseAND(F.lit(fixed | _mask(band))).alias("part"), F.array(*[F.lit(_mask(x)) for x in own[:i]]).cast("array<long>").alias("before")) for i, band in enumerate(own)])
            choice = F.when(F.col("at") == text, made).otherwise(choice)
        placed = waiting.select("h", F.explode(choice).alias("b")).select("h", "b.at", "b.part", "b.before").checkpoint()
        sizes = placed.groupBy("at", "part").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > most)
        paths = [tuple(map(int, r["at"].split(".")[:-1])) for r in large.select("at").distinct().collect()]
        level = [(p, s) for p in paths if (s := _splits(p, order, distance)) is not None]
        if sum(len(s) for _, s in level) > MOST_BANDS:
            return None
        going_on = ["".join(f"{x}." for x in p) for p, _ in level]
        split = large.where(F.col("at").isin(going_on)).select("at", "part")
        here = placed.join(split, ["at", "part"], "left_anti") if level else placed
        other = here.select(F.col("h").alias("g"), "at", "part")
        differ = F.col("h").bitwiseXOR(F.col("g"))
        first = F.forall("before", lambda m: differ.bitwiseAND(m) != 0)  # they agree in none of the bands before
        found = here.join(other, ["at", "part"]).where((F.col("h") < F.col("g")) & (F.bit_count(differ) <= distance) & first).select("h", "g", F.bit_count(differ).alias("hamming"))
        met = found if met is None else met.unionByName(found)
        if level:
            waiting = placed.join(split, ["at", "part"]).select("h", "at").distinct()
    return met.distinct()


def hamming_pairs(hashes: DataFrame, key: str, value: str, distance: int, bits: int = 64, most: int = MOST_IN_BUCKET) -> DataFrame:
    """first, second, hamming: pairs of keys (first < second) whose hashes differ in at most ``distance`` bits.

    Equal hashes are distance 0.  Null hashes pair with nothing.  Hashes are compared
    in buckets of one band's bits.  A bucket of more than ``most`` distinct hashes (a
    band of constant bits has all of them) is split by bands of the other bits: those
    of its pairs differ in none of the bucket's bits, so they agree in one of the
    further bands.  In a bucket a pair is listed only if it agrees in none of the bands
    before; what split buckets list twice is made distinct.

    If bands list more than BAND_SHARE of all pairs (a few bits each, as the distance is
    a large part of the bits), or if splits have more than MOST_BANDS bands, all
    pairs are compared in blocks instead: the same pairs, with a plan of fixed size.
    """
    rows = hashes.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("long").alias("h"))
    distinct = rows.select("h").distinct().checkpoint()
    n, shares = bit_shares(distinct, "h", bits)
    order = _even_first(shares)
    met = _near_in_bands(distinct, order, distance, most) if listed_share(shares, order, distance) <= BAND_SHARE else None
    if met is None:
        met = _near_in_blocks(distinct, n, distance)
    met = met.unionByName(distinct.select("h", F.col("h").alias("g"), F.lit(0).alias("hamming")))
    left, right = rows.select(F.col("k").alias("x"), "h"), rows.select(F.col("k").alias("y"), F.col("h").alias("g"))
    pairs = met.join(left, "h").join(right, "g")
    both = pairs.where((F.col("h") != F.col("g")) | (F.col("x") < F.col("y"))).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("second"), F.col("hamming").cast("int").alias("hamming"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are tied to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.min("low").alias("root")).select("high", F.least("high", "root").alias("root"))
    return both.join(least, "high").where("low > high").select(F.col("low").alias("high"), F.col("root").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are tied to the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("root"))
    moved = edges.join(least, "high").where("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low"))
    return moved.unionByName(least.select("high", F.col("root").alias("low"))).distinct()


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node), ``edges`` (first, second) -> node, root: the smallest node reachable.

    Star steps until nothing changes: some log of the longest chain's length.  A hub
    with a large part of all edges is a grouped minimum, added up in each task first.
    """
    spark = nodes.sparkSession
    now, path = _stored(edges.where("first <> second").select(F.greatest("first", "second").alias("high"), F.least("first", "second").alias("low")).distinct())
    state = None
    while True:
        new, new_path = _stored(_small_star(_large_star(now)))
        _dropped(spark, path)
        now, path = new, new_path
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def visual_groups(labels: DataFrame, attributes: DataFrame, label: str) -> DataFrame:
    """``labels`` (node, root), ``attributes`` (node, label) -> node, group_id, group_size, cross_label_conflict, is_valid.

    Groups are numbered by their smallest member; a group with two labels is a conflict.
    """
    rows = labels.join(attributes.select("node", label), "node")
    groups = rows.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"), (F.count_distinct(label) > 1).alias("cross_label_conflict"))
    from lumenlake.operators.resample import numbered

    order = numbered(groups.withColumn("root_key", F.col("root")), "root_key").select(F.col("root_key").alias("root"), "n")
    named = groups.join(order, "root").withColumn("group_id", F.format_string("visual_group_%04d", F.col("n") + 1))
    return rows.join(named, "root").select("node", "group_id", "group_size", "cross_label_conflict", (~F.col("cross_label_conflict")).alias("is_valid"))
