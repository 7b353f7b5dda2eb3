r"""Exact duplicates by a tree merge of sorted digest runs (DataFrame operations only).

Texts are equal when they are identical after each run of ``[\x20\x09-\x0D]`` is
replaced by one space.  A scan turns every text into its digest (SHA-256) and two
witnesses (length and a 64-bit hash of another family); the rows of one partition
are one run.  Runs are numbered, and number and digest are read as digits of base
``FAN``.  In round r the runs whose numbers differ in digit r alone exchange
stretches: a row goes to the run whose digit r is the digest's digit r, so each run
merges ``FAN`` sorted stretches and keeps, for each digest, the smallest identifier
and the number of rows.  A run is never gathered whole, all runs stay equally large,
and after the last round a digest lies in one run only.  Even the copies of a text
that a third of all rows hold meet ``FAN`` at a time.

A level is merged by a sort aggregate (the smallest identifier is a struct), with
rows combined before they move.  "Equal" is verified at every level: rows merge only
if digest and both witnesses agree.  Decisions go back down the same tree, level by
level, so no join sees more than ``FAN`` rows of a key (the last: those of ``FAN``
partitions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.shared import write_table

#: Runs that exchange stretches in a round; a power of two.
FAN_BITS = 4
FAN = 1 << FAN_BITS
#: A run of white space that is not already one space.
LONG_SPACE = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
#: What rows must agree in to be copies of each other.
TEXT = ["digest", "length", "witness"]


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), LONG_SPACE, " ")


def runs(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) -> one line a row: run, identity, digest and witnesses of its text."""
    own = rows.select("row", "doc_id", normalised(F.col("text")).alias("text"))
    return own.select(
        F.shiftright("row", 33).alias("run"),
        F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row").alias("keeper"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.length("text").cast("long").alias("length"),
        F.xxhash64("text").alias("witness"),
    )


def _exchanged(round_: int) -> Column:
    """The run that a row goes to: digit ``round_`` of its run becomes the digest's."""
    low = round_ * FAN_BITS
    digit = F.shiftrightunsigned(F.xxhash64("digest"), low).bitwiseAND(FAN - 1)
    old = F.shiftrightunsigned("run", low).bitwiseAND(FAN - 1)
    return F.col("run") + F.shiftleft(digit - old, low)


def resolve(lines: DataFrame) -> DataFrame:
    """``runs`` -> the same lines with ``kept`` (identity of the row that stays) and ``size`` of their group.

    Rounds: as many as the greatest run number has digits.  ``lines`` is read for
    each level and should be a written table.
    """
    most = lines.agg(F.max("run")).first()[0] or 0
    rounds = max(1, -(-int(most).bit_length() // FAN_BITS))
    levels = [lines.select("run", "keeper", *TEXT, F.lit(1).cast("long").alias("size"))]
    for r in range(rounds):
        moved = levels[-1].withColumn("run", _exchanged(r))
        levels.append(moved.groupBy("run", *TEXT).agg(F.min("keeper").alias("keeper"), F.sum("size").alias("size")))
    known = levels[-1].withColumnsRenamed({"keeper": "kept"})
    for r in reversed(range(rounds)):
        lower = levels[r].select(F.col("run").alias("own"), _exchanged(r).alias("run"), "keeper", *TEXT)
        known = lower.join(known, ["run", *TEXT]).select(F.col("own").alias("run"), *TEXT, "keeper", "kept", "size")
        if r:
            known = known.drop("keeper")
    return known


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text), dropped ones too.

    A null text is empty, so nulls and empty texts are copies of each other (a text
    of white space alone is one space, another text).  Of equal texts the row with
    the smallest doc_id stays; null ids come last (keep_id is null if all are), and
    of rows that share even the smallest id exactly one stays.  Repeated rows count
    each in group_size.  Texts of any length are read whole.  Other columns are
    ignored.  An empty table gives an empty one.
    """
    lines, _ = write_table(runs(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")))
    found = resolve(lines)
    return found.select(F.col("keeper.doc_id").alias("doc_id"), F.col("kept.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("keeper.row") == F.col("kept.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept; ``groups`` says which."""
    held, _ = write_table(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), F.monotonically_increasing_id().alias("row")))
    lines, _ = write_table(runs(held.select("row", "document.doc_id", "document.text")))
    staying = resolve(lines).where("keeper.row = kept.row").select(F.col("keeper.row").alias("row"))
    return held.join(staying, "row", "left_semi").select("document.*")


#: DuckDB SQL of ``op11_exact_dedup``.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept FROM d
)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM g
"""
