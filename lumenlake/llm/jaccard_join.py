"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct five-word shingles ("tokens").  Two sets
link when ``den * |x & y| >= num * |x | y|`` (0.75 by default).  The join finds
every link without comparing all pairs:

1. Equal sets are one node (``set_id``, a hash of the whole set), so exact copies
   are never joined with each other.
2. Tokens have a class.  *Frequent* tokens (found by lossy counting over all
   documents, at most ``1 / hot_share`` of them whatever the input) form class 2,
   all others class 1.  The global order is: class-1 tokens of the low hash range
   by (document frequency, hash), the other class-1 tokens by hash, class 2 by
   hash.
3. With tau = n - ceil(t n) a set can miss at most tau tokens of a partner, so
   two linked sets share one of their first tau + 1 tokens.  Where class 1 has
   that many, single tokens are indexed, rarest first.  Where it has fewer, the
   prefix is *extended* into class 2, which is indexed by combinations of two
   neighbouring tokens: if nothing of class 1 is shared, each side has spent its
   misses there, and of the next tokens so many are common that two of them are
   neighbours on both sides (each miss parts one pair of common neighbours; see
   ``_frequent_prefix``).  Their number is linear in the set, not quadratic.
4. Index lists are resolved without all their pairs: each list links its members
   to one leader, links are verified on the whole sets and components are formed;
   that is done twice, and then the sets of lists with one leader are compared
   whole, in blocks without listing their pairs.  Pairs whose sizes or lonely tokens
   (which no other set has) rule a link out are not verified.  All decisions are
   exact; nothing is capped.

Scale: texts never shuffle.  The documents are scanned four times by vectorised
Python (Arrow batches): for their sets' ids and frequent tokens, for the low range,
for the other signatures, and for the whole sets of candidates, which are written as
a table once and read from there.  What shuffles are class-1 tokens of the low hash
range (5/16 of all tokens) and, for candidates only, whole sets.  Broadcast are the
frequent tokens (at most 65,536 longs) and a bit set of candidates, FILTER_BITS long
at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm import shared
from lumenlake.llm.components import components

#: Links need num/den of the union in common.
SIMILARITY = (75, 100)
#: A token is frequent from this share of all token occurrences; at most 1 / HOT_SHARE tokens are.
HOT_SHARE = 1 / 65536
#: ... and from so many occurrences at least.
HOT_LEAST = 64
#: Hashes below this are counted; the rest of class 1 comes after them in the order.
LOW = np.uint64((5 << 60) - 1)
#: Rounds in which an index list's members meet one leader, before those still apart meet each other.
STAR_ROUNDS = 2
#: Tokens of a block when groups are compared whole.
BLOCK_TOKENS = 200_000
#: Bits of the candidate filter: sixteen for each candidate within these limits (128 kB, 32 MB).
FILTER_BITS = (1 << 20, 1 << 28)


def _set_id(tokens: np.ndarray) -> int:
    total = shared.mix(tokens * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    mixed = shared.mix(np.array([total], dtype=np.uint64) + np.uint64(len(tokens)))
    return int(mixed.view(np.int64)[0])


def _budget(n: int, num: int, den: int) -> int:
    """How many of n tokens a linked set may lack."""
    return n - -(-num * n // den)


def _frequent_prefix(frequent: np.ndarray, n: int, spent: int, num: int, den: int) -> np.ndarray:
    """Combinations of neighbouring frequent tokens that a set must index.

    If no token of class 1 is shared, the ``spent`` ones here are misses.  Then dx
    of the first L frequent tokens can miss (dx <= tau - spent), and with the
    other side's misses at most q = n (1 - t) / t - spent.  At least L - dx are
    common, with L - dx - 1 gaps, of which q are broken: L = 2 + dx + q leaves one.
    With fewer than L tokens all are used; 3/7 of both sizes are common and 1/7
    missed (t = 0.75), so a pair remains if both sizes add up to 7, and smaller
    sets that link are equal.
    """
    length = 2 + _budget(n, num, den) - spent + max(0, n * (den - num) // num - spent)
    part = frequent[:length]
    return shared.mix(part[:-1] * np.uint64(0xA24BAED4963EE407) + part[1:])


# ------------------------------------------------------------------ scans


def _scan(docs: DataFrame, schema: T.StructType, each) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)

    return shared.map_arrow(docs, run, schema)


def document_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_id) of all documents, and (token, hits) of locally frequent tokens."""
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.LongType()), T.StructField("token", T.LongType()), T.StructField("hits", T.LongType())])

    def each(batches):
        held: list[np.ndarray] = []
        weight = 0

        def settle(ids_type):
            """Lossy counting: what falls short of the share in this run of documents cannot matter."""
            nonlocal weight
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(2, weight * HOT_SHARE)
            held.clear()
            weight = 0
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(none), ids_type), none, none, pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], schema=out_schema)

        for batch in batches:
            ids = batch.column(0)
            out_schema = pa.schema([("doc_id", ids.type), ("n_shingles", pa.int64()), ("set_id", pa.int64()), ("token", pa.int64()), ("hits", pa.int64())])
            n = len(ids)
            sizes = np.zeros(n, np.int64)
            sets = np.zeros(n, np.int64)
            for row, part in shared.shingle_sets(batch.column(1)):
                sizes[row] = len(part)
                if len(part):
                    sets[row] = _set_id(part)
                    held.append(part.copy())
                    weight += len(part)
                    if weight >= 1 << 20:
                        yield settle(ids.type)
            nulls = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sets, mask=sizes == 0), nulls, nulls], schema=out_schema)
        if held:
            yield settle(ids.type)

    both = shared.cut(_scan(docs.select("doc_id", "text"), schema, each))
    return both.where("hits IS NULL").select("doc_id", "n_shingles", "set_id"), both.where("hits IS NOT NULL").select("token", "hits")


def _prefixes(docs: DataFrame, hot, num: int, den: int, low: bool) -> DataFrame:
    """(sig, set_id, n, n_low): the class-1 tokens of the low range (``low``), or the signatures that need no frequencies.

    n_low is how many class-1 tokens of the low range the set has.
    """

    def each(batches):
        frequent = hot.value
        seen: set[int] = set()  # sets of this task: a copy adds nothing

        def split(part):
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, part), len(frequent) - 1)
                is_hot = frequent[at] == part
                return part[~is_hot], part[is_hot]
            return part, part[:0]

        def out(rows):
            values = np.concatenate([r[0] for r in rows]).view(np.int64)
            lengths = [len(r[0]) for r in rows]
            columns = [np.repeat(np.array([r[i] for r in rows], kind), lengths) for i, kind in ((1, np.int64), (2, np.int32), (3, np.int32))]
            return pa.RecordBatch.from_arrays([pa.array(values), *map(pa.array, columns)], names=["sig", "set_id", "n", "n_low"])

        rows, held = [], 0
        for batch in batches:
            for _, part in shared.shingle_sets(batch.column(0)):
                n = len(part)
                if not n or (me := _set_id(part)) in seen:
                    continue
                seen.add(me)
                rare, often = split(part)
                n_low = int(np.searchsorted(rare, LOW, "right"))
                need = _budget(n, num, den) + 1
                if low:
                    own = rare[:n_low].copy()
                else:
                    own = rare[n_low:need].copy() if n_low < need else rare[:0]
                    if len(rare) < need and len(often) > 1:
                        own = np.concatenate([own, np.unique(_frequent_prefix(often, n, len(rare), num, den))])
                if len(own):
                    rows.append((own, me, n, n_low))
                    held += len(own)
                    if held >= 200_000:
                        yield out(rows)
                        rows, held = [], 0
        if rows:
            yield out(rows)

    return _scan(docs.select("text"), "sig long, set_id long, n int, n_low int", each)


def _index(docs: DataFrame, hot, num: int, den: int) -> DataFrame:
    """(sig, set_id, n, lone): the index lists that have two sets at least.

    lone counts tokens of the set that no other set has, of those in the low range.
    """
    low = _prefixes(docs, hot, num, den, True)
    # No token here is frequent, so none has more than a 65,536th of the rows.
    by_token = Window.partitionBy("sig")
    counted = low.withColumns({"df": F.count(F.lit(1)).over(by_token), "r0": F.min("set_id").over(by_token), "r1": F.max("set_id").over(by_token)}).where("r0 <> r1").drop("r0", "r1")
    by_set = Window.partitionBy("set_id")
    own = counted.repartition("set_id").dropDuplicates(["set_id", "sig"])
    place = F.row_number().over(by_set.orderBy("df", "sig"))
    lone = F.col("n_low") - F.count(F.lit(1)).over(by_set).cast("int")  # these come first in the order
    need = F.least(F.col("n_low"), F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)).cast("int") + 1)
    own = shared.cut(own.withColumns({"place": place, "lone": lone}).select("sig", "set_id", "n", "lone", F.expr("place = 1").alias("first"), (F.col("place") <= need - F.col("lone")).alias("inside")))
    known = own.where("first").select("set_id", "lone")
    direct = _prefixes(docs, hot, num, den, False).join(known, "set_id", "left").select("sig", "set_id", "n", F.coalesce("lone", "n_low").alias("lone"))
    # dealt by both columns: a list may hold a large part of all sets
    rows = own.where("inside").select("sig", "set_id", "n", "lone").unionByName(direct)
    rows = shared.cut(rows.dropDuplicates(["sig", "set_id"]))
    # Lists of the same sets say the same: one of them stays.  Lists of one set say nothing.
    mark = F.xxhash64(F.col("set_id"), F.lit(1)).cast("decimal(38,0)")
    lists = rows.groupBy("sig").agg(F.sum(mark).alias("mark"), F.count(F.lit(1)).alias("m")).where("m > 1")
    kept = lists.groupBy("mark", "m").agg(F.min("sig").alias("sig")).select("sig")
    return shared.cut(rows.join(kept, "sig"))


# ------------------------------------------------------------------ verification


def _possible(a: str, b: str, num: int, den: int):
    """Sizes near enough, and enough tokens that are not known to be alone on either side."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = F.least(n, m) * den >= F.greatest(n, m) * num
    common = F.least(n - F.col(f"{a}.lone"), m - F.col(f"{b}.lone"))
    return near & (common * (den + num) >= (n + m) * num)


def _candidate_filter(spark: SparkSession, ids: DataFrame):
    """A bit set of the ``ids`` (set_id); it only saves work, joins decide."""
    n = ids.count()
    size = min(max(1 << (16 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.pmod("set_id", F.lit(size))
    rows = ids.groupBy(F.floor(slot / F.lit(32768)).alias("k")).agg(F.bitmap_construct_agg(F.pmod(slot, F.lit(32768))).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in rows:
        bits[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast(bits)


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, str]:
    """(set_id, tokens: packed sorted hashes) of the sets in ``wanted`` (and of few others) as a table, and its path."""
    bits = _candidate_filter(docs.sparkSession, wanted)

    def each(batches):
        chosen = bits.value
        mask = len(chosen) * 8 - 1
        seen: set[int] = set()
        ids, sets, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["set_id", "tokens"])

        for batch in batches:
            for _, part in shared.shingle_sets(batch.column(0)):
                if not len(part):
                    continue
                me = _set_id(part)
                slot = me & mask
                if chosen[slot >> 3] >> (slot & 7) & 1 and me not in seen:
                    seen.add(me)
                    ids.append(me)
                    sets.append(part.tobytes())
                    size += len(sets[-1])
                    if size >= 4 << 20:
                        yield out()
                        ids, sets, size = [], [], 0
        if ids:
            yield out()

    return shared.write_table(_scan(docs.select("text"), "set_id long, tokens binary", each).dropDuplicates(["set_id"]))


def _verified(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def similar(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("y")), "b")
    return shared.map_arrow(with_b.select("a", "b", "x", "y"), similar, "a long, b long")


def _verified_blocks(sets: DataFrame, queries: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between ``queries`` and ``members`` (hub, set_id, n, root) of one hub and of different components (root).

    Groups may be large, so no pairs are listed: members and queries are cut into
    blocks of about BLOCK_TOKENS tokens, and each block of queries meets each block
    of members, whose tokens are one sorted array.  Of a query's links in a block
    one to each component is enough, as components are connected.
    """
    sizes = members.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("int").alias("m_blocks"))
    sizes = sizes.join(queries.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("int").alias("q_blocks")), "hub")
    placed = {}
    for name, frame, own, other in (("m", members, "m_blocks", "q_blocks"), ("q", queries, "q_blocks", "m_blocks")):
        rows = frame.join(sizes, "hub").join(sets, "set_id")
        mine = F.pmod(F.xxhash64("set_id"), F.col(own)).cast("int")
        rows = rows.select("hub", "set_id", "root", "tokens", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
        # columns of their own: both sides come from the same tables
        rows = rows.select(*[F.col(c).alias(f"{name}_{c}") for c in ("hub", "m_blocks", "q_blocks", "set_id", "root", "tokens")])
        placed[name] = rows.groupBy(f"{name}_hub", f"{name}_m_blocks", f"{name}_q_blocks")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            names, roots = left["m_set_id"].to_numpy(), left["m_root"].to_numpy()
            parts = [np.frombuffer(x, np.uint64) for x in left["m_tokens"].to_pylist()]
            lengths = np.array([len(x) for x in parts])
            tokens = np.concatenate(parts)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], np.repeat(np.arange(len(parts)), lengths)[order]
            for me, root, blob in zip(right["q_set_id"].to_pylist(), right["q_root"].to_pylist(), right["q_tokens"].to_pylist(), strict=True):
                x = np.frombuffer(blob, np.uint64)
                low, high = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
                hits = high - low
                total = int(hits.sum())
                at = np.arange(total) + np.repeat(low - np.cumsum(hits) + hits, hits)
                common = np.bincount(owner[at], minlength=len(parts))
                linked = np.flatnonzero((den * common >= num * (len(x) + lengths - common)) & (roots != root))
                _, first = np.unique(roots[linked], return_index=True)
                a += [me] * len(first)
                b += names[linked[first]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed["m"].cogroup(placed["q"]).applyInArrow(meet, "a long, b long")


def _apart(sets: DataFrame, named: DataFrame, num: int, den: int) -> DataFrame:
    """Links between members of ``named`` lists (sig, set_id, n, lone, root) that are in different components.

    Lists with one leader make one group (its hub), so two sets that any list
    holds are in a group together, and there are no more (hub, set) rows than list
    entries.  In a group all sets outside its largest component are compared with
    all its sets.  Sets too many of whose tokens are alone can link with none.
    """
    named = shared.cut(named.where((F.col("n") - F.col("lone")) * den >= F.col("n") * num))
    leaders = named.groupBy("sig").agg(F.min(F.struct("lone", "set_id")).alias("x"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    members = shared.cut(named.join(leaders.select("sig", F.col("x.set_id").alias("hub")), "sig").select("hub", "set_id", "n", "root").distinct())
    largest = members.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("hub").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
    queries = shared.cut(members.join(largest, "hub").where("root <> largest").select("hub", "set_id", "n", "root"))
    if queries.isEmpty():
        return queries.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))
    return shared.cut(_verified_blocks(sets, queries, members, num, den))


def _all_lone(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, all_lone) of the sets ``wanted`` (set_id): how many of all tokens of a set none of the others has."""

    def each(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                ids, blobs = batch.column(0)[i : i + 100], batch.column(1)[i : i + 100].to_pylist()
                tokens = np.frombuffer(b"".join(blobs), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(ids.to_numpy(), [len(x) // 8 for x in blobs]))], names=["token", "set_id"])

    owners = shared.map_arrow(sets.join(wanted, "set_id", "left_semi").select("set_id", "tokens"), each, "token long, set_id long").groupBy("token").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("last"))
    return owners.where("set_id = last").groupBy("set_id").agg(F.count(F.lit(1)).cast("int").alias("all_lone"))


def _hot(heavy: DataFrame, total: int, num: int, den: int):
    """The frequent tokens, sorted, as a broadcast."""
    hot: list[int] = []
    if 4 * num >= 3 * den:  # below 0.75 neighbouring frequent tokens prove nothing: all tokens are class 1
        least = max(HOT_LEAST, total * HOT_SHARE)
        hot = [r[0] for r in heavy.groupBy("token").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= least).select("token").collect()]
    return heavy.sparkSession.sparkContext.broadcast(np.sort(np.array(hot, dtype=np.int64).view(np.uint64)))


def set_links(docs: DataFrame, heavy: DataFrame, total: int, num: int, den: int) -> DataFrame:
    """(node, root) over set ids: the components of all links between different sets."""
    spark = docs.sparkSession
    index = _index(docs, _hot(heavy, total, num, den), num, den)
    sets, path = _whole_sets(docs, index.select("set_id").distinct())

    edges = spark.createDataFrame([], "a long, b long")
    tried = edges
    labels = spark.createDataFrame([], "node long, root long")
    for turn in range(STAR_ROUNDS + 1):
        if index.isEmpty():
            break
        named = index.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        apart = named.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("sig")
        named = shared.cut(named.join(apart, "sig"))
        if turn == 1:
            # For what is left, count lonely tokens in the whole sets: better leaders, and fewer pairs that may link.
            lone = _all_lone(sets, named.select("set_id").distinct())
            index = shared.cut(named.join(lone, "set_id", "left").select("sig", "set_id", "n", F.greatest("lone", F.coalesce("all_lone", F.lit(0))).alias("lone")))
            named = index.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        if turn == STAR_ROUNDS:
            found = _apart(sets, named, num, den)
        else:
            # Each list's members against its leader, the set with the fewest tokens of its own.
            leaders = named.groupBy("sig").agg(F.min(F.struct("lone", "set_id", "n", "root")).alias("x"))
            pairs = named.select("sig", F.struct("set_id", "n", "lone", "root").alias("y")).join(leaders, "sig")
            pairs = pairs.where("x.root <> y.root").where(_possible("x", "y", num, den))
            pairs = pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()
            pairs = shared.cut(pairs.join(tried, ["a", "b"], "left_anti"))
            if pairs.isEmpty():
                continue
            tried = tried.unionByName(pairs)
            found = shared.cut(_verified(sets, pairs, num, den))
        if not found.isEmpty():
            edges = edges.unionByName(found)
            labels = shared.cut(components(edges))
    shared.drop_table(spark, path)
    return labels


def links(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) -> classes (doc_id, n_shingles, set_id, copies, links) and pairs (a, b: set_id) of all links.

    A class are the documents of one set; copies says how many they are, links with
    how many other documents one links: its copies, and the copies of the sets that
    its set links with.  pairs (a < b) are all links between different sets.  Null,
    empty and blank texts have set_id null, one copy and no links.  Every two sets
    that an index list holds are compared, in blocks (see ``_apart``).
    """
    num, den = similarity
    rows, heavy = document_sets(docs)
    total = rows.agg(F.sum("n_shingles")).first()[0]
    spark = docs.sparkSession
    pairs = spark.createDataFrame([], "a long, b long")
    if total:
        index = _index(docs, _hot(heavy, total, num, den), num, den)
        sets, path = _whole_sets(docs, index.select("set_id").distinct())
        # each set is a component of its own, so no comparison is left out
        found = _apart(sets, index.withColumn("root", F.col("set_id")), num, den)
        pairs = shared.cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        shared.drop_table(spark, path)
    copies = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(copies.select(F.col("set_id").alias("b"), F.col("copies").alias("theirs")), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("theirs").alias("near"))
    counted = copies.join(near, "set_id", "left").select("set_id", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return rows.join(counted, "set_id", "left").select("doc_id", "n_shingles", "set_id", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links")), pairs


def jaccard_components(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text; more columns are ignored) -> doc_id, n_shingles, component_id, one row per input row.

    component_id is the smallest doc_id reachable over links, the row's own
    included.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of one to
    four words has one shingle, its whole sequence.  Null, empty and blank texts
    have no shingles and link with nothing (component_id is their doc_id).  Rows
    with equal texts link, repeated doc_ids included; a null doc_id is never the
    smallest.  An empty table gives an empty one.
    """
    num, den = similarity
    if not 0 < num <= den:
        raise ValueError("similarity must be in (0, 1]")
    rows, heavy = document_sets(docs)
    labels = _labels(docs, rows, heavy, num, den)
    if labels is None:
        return rows.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    least = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    joined = least.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    joined = shared.cut(joined)
    whole = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"))
    # Only sets of groups of two documents at least need a label; all others keep their doc_id.
    final = joined.join(whole.where("members > 1"), "root").select("set_id", "component_id")
    return rows.join(final, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _labels(docs: DataFrame, rows: DataFrame, heavy: DataFrame, num: int, den: int) -> DataFrame | None:
    total = rows.agg(F.sum("n_shingles")).first()[0]
    return set_links(docs, heavy, total, num, den) if total else None


def distinct_documents(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row of ``docs`` (doc_id, text, any columns) of each group of linked documents: that of the smallest doc_id.

    Null doc_ids are the last choice.  Documents without shingles are groups of
    their own and all stay; of repeated rows one stays.  The columns are those of
    ``docs``.  Texts shuffle once, by (doc_id, set), so copies are spread.
    """
    num, den = similarity
    rows, heavy = document_sets(docs)
    labels = _labels(docs, rows, heavy, num, den)
    if labels is None:
        return docs
    named = rows.where("set_id IS NOT NULL").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "set_id")).alias("first")
    kept = named.groupBy(F.coalesce("root", "set_id").alias("group")).agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.set_id").alias("kept_set"), F.lit(True).alias("kept_row"))
    at = docs.columns.index("text")

    def each(batches):
        for batch in batches:
            sets = np.zeros(batch.num_rows, np.int64)
            empty = np.ones(batch.num_rows, bool)
            for row, part in shared.shingle_sets(batch.column(at)):
                if len(part):
                    sets[row], empty[row] = _set_id(part), False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, mask=empty)], names=[*batch.schema.names, "own_set_id"])

    own = _scan(docs, T.StructType([*docs.schema.fields, T.StructField("own_set_id", T.LongType())]), each)
    joined = own.join(shared.cut(kept), own["doc_id"].eqNullSafe(F.col("kept_id")) & own["own_set_id"].eqNullSafe(F.col("kept_set")), "left")
    others = [c for c, t in docs.dtypes if c != "doc_id" and not t.startswith("map")]
    again = F.row_number().over(Window.partitionBy("doc_id", "own_set_id").orderBy(*others)) if others else F.lit(1)
    joined = joined.where("own_set_id IS NULL OR kept_row").withColumn("again", again)
    return joined.where("own_set_id IS NULL OR again = 1").select(*docs.columns)


#: DuckDB SQL of ``op3_ngram_jaccard_join`` (exact, all pairs that share a shingle).
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * common >= 75 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION
  SELECT reach.root, links.b FROM reach JOIN links ON links.a = reach.node
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""
