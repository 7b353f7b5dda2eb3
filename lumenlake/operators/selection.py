"""Tuning, nested cross-validation, ablation and transfer of logistic models as batches of fits over one table.

Every function turns a design (repeats, folds, values of C, subsets of columns,
datasets) into parts and fits of ``batched``, fits them all in shared scans and
returns predictions or summaries.  Rows of any number; a design's size is that of its
grid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import bootstrap, folds, kernels, metrics, resample, trees
from lumenlake.operators.batched import Fit, Fitted, Held, Replicate, Study, aucs, collapsed, fit, labelled, predict, prepare, written
from lumenlake.operators.ordered import STRETCHES
from lumenlake.operators.relational import share_weight
from lumenlake.session import settings, spread

#: Rows that a task orders at once when a permutation is measured.
ROWS_IN_ORDER = 1_000_000
#: Values of C (fixed values of the study protocol).
C_GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
#: Rows of a table whose permutations are each made and ranked where they are, as arrays (34 bytes a row in a task); those of a larger one move its shares.
PERMUTED_AT_ONCE = 1 << 24
#: Rows of a packed record, and rows that a permutation sends on at once.
ROWS_IN_PACK, SENT_AT_ONCE = 1 << 18, 1 << 15


@dataclass(frozen=True)
class Design:
    """How a model sees its columns: some scaled, some as ``k`` whitened components -- an embedding alone, or fused early with features."""

    columns: Sequence[str] = ()
    embedded: Sequence[str] = ()
    k: int = 32

    def fit(self, part: int, c: float, order: Sequence[str]) -> Fit:
        at = {n: i for i, n in enumerate(order)}
        return Fit(part, float(c), tuple(at[n] for n in self.columns), tuple(at[n] for n in self.embedded), self.k if self.embedded else 0)


def _design(given: Design | Sequence[str]) -> Design:
    return given if isinstance(given, Design) else Design(tuple(given))


def _others(n: int, *left_out: int) -> tuple[int, ...]:
    return tuple(v for v in range(n) if v not in left_out)


def out_of_fold(frame: DataFrame, slots: DataFrame, repeats: int, n_folds: int, keys: Sequence[str], columns: Sequence[str], target: str, group: str, cs: Sequence[float] = C_GRID, subsets: Mapping[str, Sequence[str] | Design] | None = None, strata: Sequence[str] | None = None, equal_groups: bool = False) -> DataFrame:
    """repeat, held, subset, c, keys, target, probability, weight of every held-out row under every subset of columns and C.

    ``slots`` is of ``folds.repeated_folds``.  With ``strata`` (and ``equal_groups``)
    training weights make them (and the groups within them) alike in every training
    part, and ``weight`` does so in every held part; otherwise classes weigh alike.
    """
    study, fitted, tests, names = _folded(frame, slots, repeats, n_folds, keys, columns, target, group, cs, subsets, strata, equal_groups)
    return labelled(predict(study, fitted, tests), fitted.fits, **names)


def _folded(frame, slots, repeats, n_folds, keys, columns, target, group, cs, subsets, strata=None, equal_groups=False, share=()) -> tuple[Study, Fitted, list[tuple[int, int]], dict[str, list]]:
    """The study, the models, the tests and the labels of ``out_of_fold``."""
    subsets = dict(subsets or {"all": columns})
    rows = frame.join(slots, group)
    study = prepare(rows, [*keys, *([] if group in keys else [group])], columns, target, F.col("slots"), strata, group if equal_groups else None, share=share)
    study.parts = [Held(r, _others(n_folds, h)) for r in range(repeats) for h in range(n_folds)] + [Held(r, (h,)) for r in range(repeats) for h in range(n_folds)]
    cells = [(r, h, s, float(c)) for r in range(repeats) for h in range(n_folds) for s in subsets for c in cs]
    fits = [_design(subsets[s]).fit(r * n_folds + h, c, columns) for r, h, s, c in cells]
    tests = [(i, repeats * n_folds + r * n_folds + h) for i, (r, h, _, _) in enumerate(cells)]
    return study, fit(study, fits), tests, dict(zip(("repeat", "held", "subset", "c"), map(list, zip(*cells, strict=True)), strict=True))


def tuned_folds(frame: DataFrame, slots: DataFrame, repeats: int, n_folds: int, columns: Sequence[str], target: str, group: str, cs: Sequence[float] = C_GRID, subsets: Mapping[str, Sequence[str] | Design] | None = None) -> DataFrame:
    """``tuned`` of ``out_of_fold`` without a row for each score: a group lies in one fold, so its rows' share is that of its size."""
    study, fitted, tests, names = _folded(frame, slots, repeats, n_folds, [], columns, target, group, cs, subsets, share=[group])
    each = aucs(study, fitted, tests, {n: names[n] for n in ("subset", "c", "repeat")}, "share")
    return each.groupBy("subset", "c").agg(F.avg("auc").alias("auc")).orderBy("subset", F.desc(F.round("auc", 12)), "c")


def tuned_parts(frame: DataFrame, slots: DataFrame, repeats: int, n_folds: int, columns: Sequence[str], target: str, group: str, strata: Sequence[str], cs: Sequence[float] = C_GRID) -> DataFrame:
    """``tuned_by_part`` of ``out_of_fold`` with strata and equal groups, without a row for each score."""
    study, fitted, tests, names = _folded(frame, slots, repeats, n_folds, [], columns, target, group, cs, None, strata, True)
    return _best_by_part(aucs(study, fitted, tests, names))


def tuned(scores: DataFrame, group: str, target: str) -> DataFrame:
    """subset, c, auc of ``out_of_fold``, best first: the mean over repeats of the group-balanced AUC, ties to the smaller C."""
    weighted = share_weight(scores.drop("weight"), ["repeat", "subset", "c", group])
    each = metrics.auc(weighted, ["subset", "c", "repeat"], target, "probability", "weight")
    return each.groupBy("subset", "c").agg(F.avg("auc").alias("auc")).orderBy("subset", F.desc(F.round("auc", 12)), "c")


def tuned_by_part(scores: DataFrame, target: str) -> DataFrame:
    """subset, c, auc, best: the mean over (repeat, held part) of the AUC under the part's own weights; the first C of the greatest one is best."""
    return _best_by_part(metrics.auc(scores, ["subset", "c", "repeat", "held"], target, "probability", "weight"))


def _best_by_part(each: DataFrame) -> DataFrame:
    table = each.groupBy("subset", "c").agg(F.avg("auc").alias("auc"))
    top = table.groupBy("subset").agg(F.max_by("c", F.struct(F.round("auc", 12), -F.col("c"))).alias("_c"))
    return table.join(top, "subset").select("subset", "c", "auc", (F.col("c") == F.col("_c")).alias("best"))


def nested(frame: DataFrame, group: str, keys: Sequence[str], columns: Sequence[str], target: str, repeats: int, n_folds: int, inner: int, seed: int, cs: Sequence[float] = C_GRID) -> DataFrame:
    """repeat, held, c, inner_auc, keys, target, probability: each held part scored with the C that is best inside its training part.

    The inner score of a C is the mean over inner folds of the group-balanced AUC, ties
    to the smaller C.  Inner and outer models of all repeats are one batch.
    """
    slots = folds.repeated_folds(frame, group, target, n_folds, repeats, seed, inner)
    sizes = frame.groupBy(group).agg((F.lit(1.0) / F.count(F.lit(1))).alias("share"))
    own = [*keys, *([] if group in keys else [group]), "share"]
    study = prepare(frame.join(slots, group).join(sizes, group), own, columns, target, F.col("slots"))
    everything = tuple(range(len(columns)))
    fits, tests, outer, names = [], [], [], {n: [] for n in ("repeat", "held", "turn", "c")}
    for r in range(repeats):
        for h in range(n_folds):
            slot = repeats + r * n_folds + h
            for turn in range(-1, inner):  # -1: the whole training part
                study.parts += [Held(r, _others(n_folds, h)), Held(r, (h,))] if turn < 0 else [Held(slot, _others(inner, turn)), Held(slot, (turn,))]
                for c in cs:
                    (outer if turn < 0 else tests).append((len(fits), len(study.parts) - 1))
                    fits.append(Fit(len(study.parts) - 2, float(c), everything))
                    for n, v in zip(names, (r, h, turn, float(c)), strict=True):
                        names[n].append(v)
    fitted = fit(study, fits)
    best = {}  # a row for each held part
    for r in range(repeats):  # the scores of one repeat at a time lie on disk
        with settings(frame.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            each = aucs(study, fitted, [(i, p) for i, p in tests if names["repeat"][i] == r], names, "share")
            mean = each.groupBy("repeat", "held", "c").agg(F.avg("auc").alias("inner_auc"))
            found = mean.groupBy("repeat", "held").agg(F.max_by(F.struct("c", "inner_auc"), F.struct(F.round("inner_auc", 12), -F.col("c"))).alias("_best"))
            best |= {(x["repeat"], x["held"]): (x["_best"]["c"], x["_best"]["inner_auc"]) for x in found.collect()}
    # only the models that were chosen score the held rows
    won = [(i, p) for i, p in outer if best.get((names["repeat"][i], names["held"][i]), (None,))[0] == names["c"][i]]
    auc_of = {k: float("nan") if auc is None else auc for k, (_, auc) in best.items()}
    names["inner_auc"] = [auc_of.get((r, h), float("nan")) for r, h in zip(names["repeat"], names["held"], strict=True)]
    whole = labelled(predict(study, fitted, won), fits, **names)
    return whole.select("repeat", "held", "c", F.when(~F.isnan("inner_auc"), F.col("inner_auc")).alias("inner_auc"), *[k for k in own if k != "share"], target, "probability")


def configurations(frame: DataFrame, group: str, keys: Sequence[str], columns: Sequence[str], target: str, chosen: Mapping[str, tuple[Sequence[str] | Design, float]], repeats: int, n_folds: int, seed: int) -> DataFrame:
    """configuration, repeats, auc, auc_sd: the group-balanced AUC over repeated folds of each (columns, C), all under the same folds."""
    slots = folds.repeated_folds(frame, group, target, n_folds, repeats, seed)
    study = prepare(frame.join(slots, group), [*keys, *([] if group in keys else [group])], columns, target, F.col("slots"), share=[group])
    study.parts = [Held(r, _others(n_folds, h)) for r in range(repeats) for h in range(n_folds)] + [Held(r, (h,)) for r in range(repeats) for h in range(n_folds)]
    cells = [(r, h, n) for r in range(repeats) for h in range(n_folds) for n in chosen]
    fits = [_design(chosen[n][0]).fit(r * n_folds + h, chosen[n][1], columns) for r, h, n in cells]
    tests = [(i, repeats * n_folds + r * n_folds + h) for i, (r, h, _) in enumerate(cells)]
    each = aucs(study, fit(study, fits), tests, {"configuration": [c[2] for c in cells], "repeat": [c[0] for c in cells]}, "share")
    return each.groupBy("configuration").agg(F.count("auc").alias("repeats"), F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("auc_sd"))


def fused(scores: DataFrame, repeats: int, n_folds: int, group: str, keys: Sequence[str], target: str, names: Sequence[str], c: float = 1.0) -> DataFrame:
    """repeat, keys, target, <name>..., mean, stacked: late fusion of models' out-of-fold probabilities, by their mean and by a logistic model of them.

    ``scores`` (of ``out_of_fold``, one C) has the models by ``subset``.  The stacked
    model of a held part is fitted on the other parts' out-of-fold probabilities.
    """
    wide = scores.groupBy("repeat", "held", *keys, group, target).pivot("subset", list(names)).agg(F.first("probability"))
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    code = F.col("repeat") * n_folds + F.col("held")
    study = prepare(wide, ["repeat", "held", *keys, group, *names], names, target, F.array(code.cast("int")))
    value = lambda r, h: r * n_folds + h
    study.parts = [Held(0, tuple(value(r, x) for x in _others(n_folds, h))) for r in range(repeats) for h in range(n_folds)] + [Held(0, (value(r, h),)) for r in range(repeats) for h in range(n_folds)]
    fits = [Fit(i, c, tuple(range(len(names)))) for i in range(repeats * n_folds)]
    out = predict(study, fit(study, fits), [(i, repeats * n_folds + i) for i in range(len(fits))])
    return out.select("repeat", "held", *keys, group, target, *names, mean.alias("mean"), F.col("probability").alias("stacked"))


def by_dataset(frame: DataFrame, dataset: str, keys: Sequence[str], columns: Sequence[str], target: str, runs: Mapping[str, tuple[Sequence[str], Sequence[str]]], c: float = 1.0, subsets: Mapping[str, Sequence[str] | Design] | None = None, strata: Sequence[str] | None = None, group: str | None = None) -> tuple[DataFrame, Fitted]:
    """run, subset, dataset, keys, target, probability, weight: models of each run's training datasets on its test datasets.

    ``runs`` has (training datasets, test datasets) by name; a training part of one
    class gives no rows, and the models that come back say which (``valid``).  Runs
    with the same training datasets share a fit.
    """
    study, own, tests, labels = _across(frame, dataset, keys, columns, target, runs, c, subsets, strata, group)
    scores = labelled(predict(study, own, tests), own.fits, **labels)
    return scores.select("run", "subset", *study.keys, target, "probability", "weight"), own


def _across(frame, dataset, keys, columns, target, runs, c, subsets, strata, group, share=()) -> tuple[Study, Fitted, list[tuple[int, int]], dict[str, list]]:
    """The study, a model for each test, the tests and the labels of ``by_dataset``."""
    subsets = dict(subsets or {"all": columns})
    names = sorted({str(r[0]) for r in frame.select(F.col(dataset).cast("string")).where(F.col(dataset).isNotNull()).distinct().collect()})
    code = F.array_position(F.array(*map(F.lit, names)), F.col(dataset).cast("string")) - 1
    study = prepare(frame.where(F.col(dataset).isNotNull()), list(dict.fromkeys([*keys, dataset])), columns, target, F.array(code.cast("int")), strata, group, share=share)
    value = {n: i for i, n in enumerate(names)}
    parts: dict[tuple[int, ...], int] = {}
    part = lambda chosen: parts.setdefault(tuple(sorted(value[str(n)] for n in chosen if str(n) in value)), len(parts))
    fits, place, tests, labels = [], {}, [], {"run": [], "subset": []}
    for run, (train, test) in runs.items():
        for s in subsets:
            key = (part(train), s)
            if key not in place:
                place[key] = len(fits)
                fits.append(_design(subsets[s]).fit(key[0], c, columns))
            tests.append((place[key], part(test)))
            labels["run"].append(run)
            labels["subset"].append(s)
    study.parts = [Held(0, values) for values in parts]
    fitted = fit(study, fits)
    # a fit serves several runs, so each test has a model of its own from here on
    own = Fitted([fits[i] for i, _ in tests], [fitted.coefficients[i] for i, _ in tests], [fitted.constants[i] for i, _ in tests], fitted.flat[[i for i, _ in tests]], fitted.moments, fitted.scans)
    return study, own, [(t, p) for t, (_, p) in enumerate(tests)], labels


def ablation(scores: DataFrame, group: str, target: str, full: str) -> DataFrame:
    """run, subset, auc, delta of ``by_dataset`` with subsets: the group-balanced AUC, and the full model's less it."""
    weighted = share_weight(scores.drop("weight"), ["run", "subset", group])
    each = metrics.auc(weighted, ["run", "subset"], target, "probability", "weight")
    return _deltas(each, full)


def _deltas(each: DataFrame, full: str) -> DataFrame:
    whole = each.where(F.col("subset") == full).select("run", F.col("auc").alias("_full"))
    return each.join(whole, "run").select("run", "subset", "auc", (F.col("_full") - F.col("auc")).alias("delta"))


def ablated(frame: DataFrame, dataset: str, columns: Sequence[str], target: str, group: str, runs: Mapping[str, tuple[Sequence[str], Sequence[str]]], subsets: Mapping[str, Sequence[str] | Design], full: str, c: float = 1.0, strata: Sequence[str] | None = None, equal_groups: bool = False) -> DataFrame:
    """``ablation`` of ``by_dataset`` without a row for each score, for runs that test one dataset each: a row's share is that of its group's rows there."""
    if any(len(set(test)) != 1 for _, test in runs.values()):
        raise ValueError("a run must have one test dataset")
    found = _across(frame, dataset, [group], columns, target, runs, c, subsets, strata, group if equal_groups else None, [dataset, group])
    return _deltas(aucs(*found, "share").checkpoint(), full)


def stability(frame: DataFrame, group: str, columns: Sequence[str], target: str, iterations: int, seed: int, c: float = 1.0) -> DataFrame:
    """column, median, share_positive, sign_consistency, ci_low, ci_high of the coefficients of refits on every replicate of the groups.

    Replicates without both classes are left out.  Coefficients are parameters: what
    is summed up here has a row for each column and replicate.
    """
    rows, draws = bootstrap.drawn(frame, group, iterations, seed)
    study = prepare(rows, [], columns, target, draws=draws)
    study.parts = [Replicate(i) for i in range(iterations)]
    every = tuple(range(len(columns)))
    fitted = fit(study, [Fit(i, c, every) for i in range(iterations)])
    table = np.array([b for b, ok in zip(fitted.coefficients, fitted.valid(), strict=True) if ok]).reshape(-1, len(columns))
    spark = frame.sparkSession
    each = spark.createDataFrame([(n, float(v)) for j, n in enumerate(columns) for v in table[:, j]], "column string, coefficient double")
    positive = F.avg((F.col("coefficient") > 0).cast("double"))
    return each.groupBy("column").agg(F.percentile("coefficient", F.lit(0.5)).alias("median"), positive.alias("share_positive"), F.greatest(positive, 1 - positive).alias("sign_consistency"), F.percentile(F.abs("coefficient"), F.lit(0.025)).alias("ci_low"), F.percentile(F.abs("coefficient"), F.lit(0.975)).alias("ci_high"))


def machine_scores(frame: DataFrame, slots: DataFrame, n_folds: int, keys: Sequence[str], columns: Sequence[str], target: str, group: str, cs: Sequence[float] = (1.0,), gammas: Sequence[float | str | None] = ("scale",), landmarks: int = kernels.LANDMARKS, repeats: int | None = None) -> DataFrame:
    """held, c, gamma, keys, target, probability (the margin): out-of-fold scores of hinge machines over all rows, by a landmark map of the Gaussian kernel or, without gamma, linear; with ``repeats``, of so many repeats of the folds and with repeat."""
    study = prepare(frame.join(slots, group), [*keys, *([] if group in keys else [group])], columns, target, F.col("slots"))
    turns = range(repeats or 1)
    study.parts = [Held(r, _others(n_folds, h)) for r in turns for h in range(n_folds)] + [Held(r, (h,)) for r in turns for h in range(n_folds)]
    out = None
    # sums of Gaussian machines are large, so a repeat's are fitted at a time
    for linear, own in [(True, list(turns)), *[(False, [r]) for r in turns]]:
        cells = [(r, h, float(c), g) for r in own for h in range(n_folds) for c in cs for g in gammas if (g is None) == linear]
        if not cells:
            continue
        tests = [(i, (len(turns) + r) * n_folds + h) for i, (r, h, _, _) in enumerate(cells)]
        names = ({"repeat": [r for r, *_ in cells]} if repeats else {}) | {"held": [h for _, h, _, _ in cells], "c": [c for _, _, c, _ in cells], "gamma": ["linear" if g is None else str(g) for *_, g in cells]}
        if linear:
            fits = [Fit(r * n_folds + h, c, tuple(range(len(columns))), loss="hinge") for r, h, c, _ in cells]
            one = predict(study, fit(study, fits), tests).drop("weight")
        else:
            fits = [kernels.Machine(r * n_folds + h, c, g) for r, h, c, g in cells]
            one = kernels.predict(study, kernels.fit(study, fits, landmarks), tests)
        one = labelled(one, fits, **names)
        out = one if out is None else out.unionByName(one)
    return out


def tree_scores(frame: DataFrame, slots: DataFrame, n_folds: int, keys: Sequence[str], columns: Sequence[str], target: str, group: str, configurations: dict[str, trees.Ensemble]) -> DataFrame:
    """held, configuration, keys, target, probability: out-of-fold scores of ensembles of trees over all rows, all folds and configurations grown together."""
    study = prepare(frame.join(slots, group), [*keys, *([] if group in keys else [group])], columns, target, F.col("slots"))
    study.parts = [Held(0, _others(n_folds, h)) for h in range(n_folds)] + [Held(0, (h,)) for h in range(n_folds)]
    cells = [(h, n) for h in range(n_folds) for n in configurations]
    fits = [replace(configurations[n], part=h) for h, n in cells]
    scores = trees.predict(study, trees.fit(study, fits), [(i, n_folds + h) for i, (h, _) in enumerate(cells)])
    return labelled(scores, fits, held=[h for h, _ in cells], configuration=[n for _, n in cells])


# ------------------------------------------------------------------ permutation importance


def bijection(numbers: np.ndarray, size: int, key: int | np.ndarray, rounds: int = 6) -> np.ndarray:
    """A permutation of 0 .. size - 1 under a key (or each number's own), at ``numbers``: nothing is sorted and none is stored.

    Feistel rounds permute the numbers below a power of four, under four times the
    size: halves swap, one mixed with a hash of the other.  A number that lands beyond
    the size is sent on until it lies inside, which keeps the map one to one.
    """
    if np.ndim(key) == 0:
        return _walked(np.asarray(numbers, np.int64), size, *_feistel(size, int(key), rounds))
    bits = _half(size)
    mask = np.uint64((1 << bits) - 1)
    out = np.asarray(numbers).astype(np.uint64)
    keys = np.broadcast_to(np.asarray(key, np.int64), out.shape)
    beyond = np.arange(len(out))
    while len(beyond):
        left, right, own = out[beyond] >> np.uint64(bits), out[beyond] & mask, keys[beyond]
        for r in range(rounds):
            left, right = right, left ^ (bootstrap.hashed(right, bootstrap.OF_UNIT, own + r).astype(np.uint64) & mask)
        out[beyond] = (left << np.uint64(bits)) | right
        beyond = beyond[out[beyond] >= size]
    return out.astype(np.int64)


def _half(size: int) -> int:
    return max(1, (max(size - 1, 1).bit_length() + 1) // 2)


def _feistel(size: int, key: int, rounds: int = 6) -> tuple[int, list[np.ndarray]]:
    """Bits of a half, and the hashes of each round: under one key a half has few values."""
    bits = _half(size)
    return bits, [bootstrap.hashed(np.arange(1 << bits, dtype=np.uint64), bootstrap.OF_UNIT, key + r).astype(np.int64) & ((1 << bits) - 1) for r in range(rounds)]


def _walked(numbers: np.ndarray, size: int, bits: int, tables: list[np.ndarray]) -> np.ndarray:
    def step(at):
        left, right = at >> bits, at & ((1 << bits) - 1)
        for table in tables:
            mixed = table.take(right)
            mixed ^= left
            left, right = right, mixed
        left <<= bits
        left |= right
        return left

    out = step(numbers)
    beyond = np.flatnonzero(out >= size)
    at = out.take(beyond)
    while len(beyond):
        at = step(at)
        inside = at < size
        out[beyond[inside]] = at[inside]
        beyond, at = beyond[~inside], at[~inside]
    return out


def permutation_importance(frame: DataFrame, row: str, columns: Sequence[str], families: Mapping[str, Sequence[str]], target: str, group: str, c: float, permutations: int, seed: int) -> DataFrame:
    """family, permutation, drop: the fall of the group-balanced AUC when a whole family of columns is permuted over the rows.

    ``row`` is the rows' unique key.  The model is fitted once.  Rows are numbered;
    what a permutation moves is the family's share of the margin: each row sends it to
    the number that the permutation's bijection gives, and the row there adds it to the
    share of the other columns.  Of up to PERMUTED_AT_ONCE rows every task that shares
    in the permutations reads the shares of one family from the shared folder, and
    nothing moves.  Else all permutations of
    all families are one join and one grouped rank metric.
    """
    numbers = resample.numbered(frame, row)
    sizes = frame.groupBy(group).agg((F.lit(1.0) / F.count(F.lit(1))).alias("share"))
    study = prepare(frame.join(sizes, group), [row, "share"], columns, target, F.array(F.lit(0)))
    study.parts = [Held(0, (0,))]
    model = fit(study, [Fit(0, c, tuple(range(len(columns))))]).flat[0]
    margin = lambda names: sum((F.col("_x")[list(columns).index(n)] * float(model[list(columns).index(n)]) for n in names), F.lit(0.0))
    names = list(families)
    whole = sum((margin([n]) for n in columns), F.lit(float(model[-1])))
    rows = study.rows.select(row, target, "share", whole.alias("_z"), F.array(*[margin(families[f]) for f in names]).alias("_f")).join(numbers, row).drop(row)
    rows = spread(rows.withColumnRenamed("n", "_n").checkpoint())
    total = rows.count()
    base = metrics.auc(rows, [], target, "_z", "share").first()["auc"]
    family = F.element_at(F.array(*map(F.lit, names)), F.col("_family") + 1)
    final = lambda aucs: aucs.select(family.alias("family"), F.col("permutation").cast("long").alias("permutation"), (F.lit(base) - F.col("auc")).alias("drop"))
    if total <= PERMUTED_AT_ONCE:
        return final(_permuted(rows.withColumn("_y", F.col(target).cast("double")), len(names), total, permutations, seed))

    def send(batches):
        for batch in batches:
            number = batch.column(0).to_numpy()
            shares = batch.column(1).flatten().to_numpy().reshape(len(number), -1)
            step = max(1, 250_000 // max(1, len(number)))
            for j in range(len(names)):
                for first in range(0, permutations, step):
                    turn = np.repeat(np.arange(first, min(first + step, permutations)), len(number))
                    times = len(turn) // max(1, len(number))
                    to = bijection(np.tile(number, times), total, seed + 1_000_003 * j + 101 * turn)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), j, np.int32)), pa.array(turn.astype(np.int32)), pa.array(to), pa.array(np.tile(shares[:, j], times))], names=["_family", "permutation", "_n", "_moved"])

    sent = rows.select("_n", "_f").mapInArrow(send, "_family int, permutation int, _n long, _moved double")
    met = sent.join(rows, "_n").withColumn("_s", F.col("_z") - F.get("_f", F.col("_family")) + F.col("_moved"))
    return final(bootstrap.plain_auc(met, ["_family", "permutation"], target, "_s", "share", min(STRETCHES, -(-total // ROWS_IN_ORDER))))


def _permuted(rows: DataFrame, families: int, total: int, permutations: int, seed: int) -> DataFrame:
    """_family, permutation, auc of ``rows`` (_n, _z, _f, _y, share), ``total`` of them with numbers from 0: a task ranks some permutations of a family.

    Rows are packed in the order of their numbers, ROWS_IN_PACK a record, and written;
    every task reads the records of its family.  Neither driver nor a shuffle has them.
    """
    spark = rows.sparkSession
    names = ["rest", "moved", "y", "w"]

    def pack(found: pa.Table) -> pa.Table:
        number = found["_n"].to_numpy()
        order = np.argsort(number)
        z, y, w = (found[c].to_numpy()[order] for c in ("_z", "_y", "share"))
        shares = found["_f"].combine_chunks().flatten().to_numpy().reshape(len(number), -1)[order]
        first = int(number.min()) // ROWS_IN_PACK
        return pa.table({"_family": pa.array(range(families), pa.int32()), "first": pa.array([first] * families, pa.int64()), **{n: pa.array([np.ascontiguousarray(v).tobytes() for v in column], pa.binary()) for n, column in zip(names, ([z - f for f in shares.T], shares.T, [y.astype(np.int8)] * families, [w] * families), strict=True)}})

    kinds = "_family int, first long, " + ", ".join(f"{n} binary" for n in names)
    packed = written(rows.select("_n", "_z", "_y", "share", "_f").groupBy(F.expr(f"_n div {ROWS_IN_PACK}").alias("pack")).applyInArrow(pack, kinds).repartition(1 + total // ROWS_IN_PACK))
    each = max(1, min(2 * spark.sparkContext.defaultParallelism, permutations))
    turns = [packed.where(F.col("_family") == j).coalesce(1).withColumn("task", F.lit(t)) for j in range(families) for t in range(each)]

    def rank(batches):
        rest, moved, w = np.empty(total), np.empty(total), np.empty(total)
        y, family, task = np.empty(total, np.int8), None, 0
        for batch in batches:
            for r in range(batch.num_rows):
                family, first, task = (batch.column(c)[r].as_py() for c in (0, 1, 6))
                for c, (out, kind) in enumerate(((rest, float), (moved, float), (y, np.int8), (w, float))):
                    values = np.frombuffer(batch.column(2 + c)[r].as_buffer(), kind)
                    out[first * ROWS_IN_PACK : first * ROWS_IN_PACK + len(values)] = values
        if family is None:
            return
        ranks = _Ranks(y, w)
        del w
        got, number, key = np.empty(total), np.arange(SENT_AT_ONCE), np.empty(total, np.int64)
        for p in range(task, permutations, each):
            halves = _feistel(total, seed + 1_000_003 * family + 101 * p)
            for a in range(0, total, SENT_AT_ONCE):
                own = moved[a : a + SENT_AT_ONCE]
                got[_walked(number[: len(own)] + a, total, *halves)] = own
            got += rest
            yield pa.RecordBatch.from_arrays([pa.array([family], pa.int32()), pa.array([p], pa.int32()), pa.array([ranks.auc(got, key)], pa.float64())], names=["_family", "permutation", "auc"])

    with_all = turns[0]
    for one in turns[1:]:
        with_all = with_all.unionAll(one)
    with settings(spark, {"spark.sql.unionOutputPartitioning": "false"}):  # else tables of one partition would be one task together
        return with_all.mapInArrow(rank, "_family int, permutation int, auc double").checkpoint()


class _Ranks:
    """The weighted share of (positive, negative) pairs in order, of many scores of the same rows.

    Scores are sorted as whole numbers that rise with them, whose last bits name the
    row's target and weight, so nothing but the numbers is moved.  Scores that agree
    but for these bits are compared again as they are, so the order is exact.
    """

    #: Bits that targets and weights may take, and of the table that near scores are looked up by.
    MOST, NEAR = 20, 20

    def __init__(self, y: np.ndarray, w: np.ndarray):
        kinds, code = np.unique(w, return_inverse=True)
        self.bits = (2 * len(kinds) - 1).bit_length()
        self.whole = (y, w) if self.bits > self.MOST else None
        self.code = (2 * code + (y == 1)).astype(np.min_scalar_type(2 * len(kinds)))
        self.positive, self.negative = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        self.positive[1 : 2 * len(kinds) : 2], self.negative[: 2 * len(kinds) : 2] = kinds, kinds

    def auc(self, score: np.ndarray, key: np.ndarray) -> float | None:
        """``score`` and ``key`` (of whole numbers, for the sorting) are overwritten."""
        score += 0.0  # no negative nought
        if self.whole:
            y, w = self.whole
            _, wp, wn = collapsed(score, w * (y == 1), w * (y == 0))
            return self._share(float((wp * (np.cumsum(wn) - wn / 2)).sum()), wp.sum(), wn.sum())
        bits, last = self.bits, (1 << self.bits) - 1
        raw = score.view(np.int64)
        for a in range(0, len(key), SENT_AT_ONCE):
            few = slice(a, a + SENT_AT_ONCE)
            key[few] = ((_rising(raw[few]) >> bits) << bits) | self.code[few]
        key.sort()
        won, ahead, positives, near = 0.0, 0.0, 0.0, []
        for a in range(0, len(key), SENT_AT_ONCE):
            own = key[a : a + SENT_AT_ONCE]
            code = own & last
            wp, wn = self.positive.take(code), self.negative.take(code)
            below = np.cumsum(wn)
            won += float(wp @ below) + ahead * float(wp.sum())
            ahead, positives = ahead + float(below[-1]), positives + float(wp.sum())
            top = key[a : a + SENT_AT_ONCE + 1] >> bits
            same = np.flatnonzero(top[1:] == top[:-1])
            if len(same):
                near.append(top[same])
        if near:
            won += self._again(raw, key, np.unique(np.concatenate(near)))
        return self._share(won, positives, ahead)

    @staticmethod
    def _share(won: float, positives: float, negatives: float) -> float | None:
        return won / (positives * negatives) if positives * negatives > 0 else None

    def _again(self, raw: np.ndarray, key: np.ndarray, near: np.ndarray) -> float:
        """What the rows of near scores win by their exact scores, less what they won as they were sorted."""
        table, low = np.zeros(1 << self.NEAR, bool), (1 << self.NEAR) - 1
        table[near & low] = True
        found, codes = [], []
        for a in range(0, len(raw), SENT_AT_ONCE):
            own = _rising(raw[a : a + SENT_AT_ONCE])
            at = np.flatnonzero(table.take((own >> self.bits) & low))
            found.append(own[at])
            codes.append(self.code[a + at])
        exact, code = np.concatenate(found), np.concatenate(codes).astype(np.int64)
        top = exact >> self.bits
        at = near[np.minimum(np.searchsorted(near, top), len(near) - 1)] == top
        exact, code = exact[at], code[at]
        out = 0.0
        for sign, order in ((1.0, np.argsort(exact)), (-1.0, np.argsort(((exact >> self.bits) << self.bits) | code))):
            value, wp, wn = exact[order], self.positive.take(code[order]), self.negative.take(code[order])
            if sign > 0:
                start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                value, wp, wn = value[start], np.add.reduceat(wp, start), np.add.reduceat(wn, start)
            group = value >> self.bits
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            below = np.cumsum(wn)
            below -= np.repeat((below - wn)[first], np.diff(np.append(first, len(group))))
            out += sign * float(wp @ (below - wn / 2 if sign > 0 else below))
        return out


def _rising(raw: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles that have these bits."""
    return raw ^ ((raw >> 63) & 0x7FFFFFFFFFFFFFFF)
