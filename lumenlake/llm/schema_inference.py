"""One schema of nested JSON texts, with names that behave like keys of a map told from fields.

Equal rows (text, names it is nested under, wrap flag) are grouped first, so what is
read follows the distinct ones.  They are dealt by text and sorted, and a task parses
each distinct text once; the counters of its paths are multiplied by the multiplicity
of every place it occurs at.  Texts of one shape share their counters, so a task adds
up (shape, place) and spreads them over paths at the end.

Paths are a table, never a tree in one process: a row has the steps from the root,
counts by type and array lengths.  Names become ``*`` level by level from the top: a
round counts the names of all objects' paths at once, takes the highest level that
holds a path with too many, replaces the names there and adds up the paths that now
agree.  There are as many rounds as levels with maps, and one to see that none is left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.shared import cut, map_arrow

#: Objects with more distinct names than this are maps.
MOST_NAMES = 12
#: Texts nested deeper are not read (they count as bad).
MOST_DEPTH = 500
#: Counters that a task keeps before it hands them on.
MOST_KEPT = 50_000
#: Types of values, in the order of their names.
TYPES = ("array", "bad", "boolean", "double", "integer", "null", "object", "string")
#: Steps: the root, the element of an array; a member is "." and its name.
ROOT, ELEMENT, ANY = "$", "[]", ".*"


def _no_constant(name: str):
    raise ValueError(name)  # NaN and Infinity are no JSON


def parsed(text: str | None):
    """The object that ``text`` is, or None: no text, no JSON, not an object, or nested too deeply.  The last of equal names counts."""
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return None
    except ValueError:
        try:  # Python refuses to convert whole numbers of thousands of digits
            value = json.loads(text, parse_constant=_no_constant, parse_int=lambda digits: 0)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


def _name(name: str) -> str:
    """A member's step; half a surrogate pair has no UTF-8 and becomes U+FFFD."""
    return "." + (name if name.isascii() else name.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def shape(text: str | None) -> tuple | None:
    """(steps, type, count, least length, greatest length) of a text's paths, or None if it is bad."""
    value = parsed(text)
    if value is None:
        return None
    found: dict[tuple, list] = {}
    waiting = [((), value)]
    while waiting:
        steps, value = waiting.pop()
        kind, length = type(value), None
        if kind is dict:
            kind = "object"
            if len(steps) >= MOST_DEPTH and value:
                return None
            waiting += [(steps + (_name(k),), v) for k, v in value.items()]
        elif kind is list:
            kind, length = "array", len(value)
            if len(steps) >= MOST_DEPTH and value:
                return None
            below = steps + (ELEMENT,)
            waiting += [(below, v) for v in value]
        else:
            kind = "string" if kind is str else "boolean" if kind is bool else "integer" if kind is int else "double" if kind is float else "null"
        at = found.get((steps, kind))
        if at is None:
            found[steps, kind] = [1, length, length]
        else:
            at[0] += 1
            if length is not None:
                at[1], at[2] = min(at[1], length), max(at[2], length)
    return tuple(sorted((k[0], k[1], *v) for k, v in found.items()))


def _spread(kept: dict[tuple, int]) -> pa.RecordBatch:
    """Counters of whole paths from (shape, outer, inner, wrapped) -> multiplicity."""
    total: dict[tuple, list] = {}

    def add(steps, kind, n, low=None, high=None):
        at = total.get((steps, kind))
        if at is None:
            total[steps, kind] = [n, low, high]
        else:
            at[0] += n
            if low is not None:
                at[1], at[2] = min(at[1], low), max(at[2], high)

    for (own, outer, inner, wrapped), n in kept.items():
        if own is None:
            add(("!" + outer,), "bad", n)
            continue
        first, second = _name(outer), _name(inner)
        add((ROOT,), "object", n)
        add((ROOT, first), "object", n)
        base = (ROOT, first, second)
        if wrapped:
            add(base, "array", n, 1, 1)
            base += (ELEMENT,)
        for steps, kind, count, low, high in own:
            add(base + steps, kind, count * n, low, high)
    rows = [(list(s), k, *v) for (s, k), v in total.items()]
    kinds = [pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["steps", "kind", "n", "low", "high"])


def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of text, outer, inner, wrapped, n, sorted by text -> counters of paths; each run of equal texts is parsed once."""
    last, own, seen = object(), None, {}
    kept: dict[tuple, int] = {}
    weight = 0
    for batch in batches:
        for text, outer, inner, wrapped, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if text != last:
                last, own = text, shape(text)
                if own not in seen:
                    seen[own] = own
                    weight += len(own or ())
                own = seen[own]
            key = (own, outer or "", inner or "", bool(wrapped))
            if key in kept:
                kept[key] += n
            else:
                kept[key] = n
                weight += 1
            if weight > MOST_KEPT:
                yield _spread(kept)
                kept, seen, weight, last = {}, {}, 0, object()
    if kept:
        yield _spread(kept)


def _parent(level: Column | int = -1) -> Column:
    size = F.size("steps") - 1 if isinstance(level, int) and level < 0 else level
    return F.slice("steps", F.lit(1), size if isinstance(size, Column) else F.lit(size))


def _paths(rows: DataFrame) -> DataFrame:
    """One row a path: steps, a count for each type, least and greatest array length."""
    return rows.groupBy("steps").agg(*[F.sum(k).alias(k) for k in TYPES], F.min("low").alias("low"), F.max("high").alias("high"))


def _children(paths: DataFrame) -> DataFrame:
    """Distinct names of each path's objects."""
    return paths.where(F.element_at("steps", -1).startswith(".")).groupBy(_parent().alias("steps")).agg(F.count(F.lit(1)).alias("names"))


def infer(rows: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """``rows`` (text, outer, inner, wrapped) -> path, types, n_names, is_map, optional, min_len, max_len, one row a path.

    A text that is one whole JSON object v counts as the object ``$`` with the member
    outer, an object with the member inner, which is v, or [v] if wrapped; any other
    text (null, no JSON, another value, nested deeper than MOST_DEPTH) counts as type
    ``bad`` at ``!outer``.  Null names are empty, a null flag is false.  Repeated rows
    count each; of equal names in one object the last counts.  Names may hold any
    characters: paths are told apart by their steps, even where they are spelt alike.
    Other columns are ignored.  An empty table gives an empty one.
    """
    counted = rows.groupBy("text", "outer", "inner", "wrapped").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartition("text").sortWithinPartitions("text")
    raw = map_arrow(dealt, counters, "steps array<string>, kind string, n long, low long, high long")
    paths = cut(_paths(raw.select("steps", "low", "high", *[F.when(F.col("kind") == k, F.col("n")).otherwise(0).alias(k) for k in TYPES])))
    maps = None
    while True:
        many = _children(paths).where((F.col("names") > most_names) & (F.size("steps") > 1))
        level = many.agg(F.min(F.size("steps"))).first()[0]
        if level is None:
            break
        found = cut(many.where(F.size("steps") == level))
        maps = found if maps is None else maps.unionByName(found)
        key = found.select(F.col("steps").alias("above"), F.lit(True).alias("replaced"))
        own = (F.size("steps") > level) & F.get("steps", F.lit(level)).startswith(".")
        joined = paths.withColumn("above", F.when(own, _parent(F.lit(level))).otherwise(F.col("steps"))).join(key, "above", "left")
        steps = F.when(own & F.col("replaced"), F.concat(F.slice("steps", F.lit(1), F.lit(level)), F.array(F.lit(ANY)), F.slice("steps", F.lit(level + 2), F.size("steps")))).otherwise(F.col("steps"))
        paths = cut(_paths(joined.withColumn("steps", steps)))
    names = _children(paths).select(F.col("steps").alias("of"), "names")
    if maps is None:
        maps = names.where(F.lit(False)).select(F.col("of").alias("steps"), "names")
    maps = maps.select(F.col("steps").alias("of_map"), F.col("names").alias("map_names"))
    above = paths.where("object > 0").select(F.col("steps").alias("parent"), F.col("object").alias("parents"))
    last = F.element_at("steps", -1)
    member = last.startswith(".")
    whole = sum((F.col(k) for k in TYPES[1:]), F.col(TYPES[0]))
    joined = paths.join(names, F.col("steps") == F.col("of"), "left").join(maps, F.col("steps") == F.col("of_map"), "left")
    joined = joined.withColumn("up", _parent()).join(above, F.col("up") == F.col("parent"), "left")
    types = F.concat_ws("|", *[F.when(F.col(k) > 0, F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in TYPES])
    return joined.select(
        F.array_join("steps", "").alias("path"),
        types.alias("types"),
        F.coalesce("map_names", "names", F.lit(0)).cast("long").alias("n_names"),
        F.col("map_names").isNotNull().alias("is_map"),
        F.coalesce(member & (last != ANY) & (whole < F.col("parents")), F.lit(False)).alias("optional"),
        F.col("low").alias("min_len"),
        F.col("high").alias("max_len"),
    )


def click_places(clicks: DataFrame) -> DataFrame:
    """text, outer, inner, wrapped of ``clicks``: groups of client_id modulo 30 (null: 0), names by the checksum of click_id (null: of no text)."""
    g = F.coalesce(F.pmod(F.col("client_id"), F.lit(30)), F.lit(0)).cast("long")
    x = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % (g % 37 + 1)
    wrapped = F.coalesce(F.col("click_id") % 5 == 0, F.lit(False))
    return clicks.select(F.col("props").alias("text"), F.concat(F.lit("g"), g.cast("string")).alias("outer"), F.concat(F.lit("x"), x.cast("string")).alias("inner"), wrapped.alias("wrapped"))
