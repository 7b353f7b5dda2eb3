"""Ordered names of all feature columns, their families and the named groups of them.

Tables carry these columns in this order, so choosing a group is a static list
for ``select`` instead of a search in a frame's columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

SCALES = (0, 1, 2, 4)
ZONES = ("lesion", "inner", "outer")

_ENDS = ("max", "min")
_SUMMARY = ("scale_count_slope", "scale_count_r2", "density_auc")

BASIC = (
    *(f"basic_{n}" for n in ("mean", "std", "q10", "q25", "median", "q75", "q90", "iqr", "entropy", "roi_fraction")),
    *(f"basic_glcm_{n}" for n in ("contrast", "homogeneity", "energy", "correlation")),
    *(f"basic_lbp_{i:02d}" for i in range(10)),
)
FRACTAL = (
    *(f"fractal_{n}" for n in ("boundary_boxdim", "boundary_boxdim_r2", "region_boxdim", "region_boxdim_r2", "gray_dbc_slope", "gray_dbc_r2")),
    *(f"fractal_lacunarity_{n}" for n in ("s4", "s8", "s16", "s32", "mean")),
)
EXTREMA = (
    *(f"extrema_s{s}_{n}" for s in SCALES for n in (*(f"{e}_{m}" for e in _ENDS for m in ("density", "area_mean", "area_median", "area_q90", "area_entropy", "intensity_mean")), "balance", "intensity_gap")),
    *(f"extrema_{n}" for n in _SUMMARY),
)
EXTREMA_COMPACT = (*(f"extrema_s{s}_{n}" for s in SCALES for n in ("max_density", "min_density", "balance", "intensity_gap")), *(f"extrema_{n}" for n in _SUMMARY))


def _zone(zone: str) -> list[str]:
    out = []
    for s in SCALES:
        out += [f"zone_{zone}_s{s}_{n}" for n in ("max_density", "min_density", "balance", "intensity_gap")]
        out += [f"zone_{zone}_s1_{e}_boxdim" for e in _ENDS] if s == 1 else []
    return [*out, *(f"zone_{zone}_{n}" for n in _SUMMARY)]


MULTIZONE = tuple(c for z in ZONES for c in _zone(z))
MARGIN = tuple(c for c in MULTIZONE if c.startswith(("zone_inner_", "zone_outer_")))


def _multifractal(zone: str) -> list[str]:
    return [f"advanced_mf_{zone}_{signal}_{n}" for signal in ("intensity", "gradient") for n in ("d0", "d1", "d2", "spread", "r2_mean")]


def _wavelet(zone: str) -> list[str]:
    return [f"advanced_wavelet_{zone}_l{level}_{n}" for level in (3, 2, 1) for n in ("energy", "entropy", "hv_logratio", "diagonal_fraction")]


SHAPE = tuple(f"advanced_shape_{n}" for n in ("perimeter_normalized", "compactness", "solidity", "eccentricity", "axis_ratio", "convex_area_ratio", "radial_cv", "radial_entropy", "turning_abs_mean", "turning_std"))
MULTIFRACTAL = tuple(c for z in ZONES for c in _multifractal(z))
WAVELET = tuple(c for z in ZONES for c in _wavelet(z))
ADVANCED = (*(c for z in ZONES for c in (*_multifractal(z), *_wavelet(z))), *SHAPE)
COMPONENT_TREE = tuple(f"ct_{z}_a{a}_{n}" for z in ZONES for a in (16, 64, 256) for n in ("bright_mean", "dark_mean", "bright_q95", "dark_q95", "bright_fraction", "dark_fraction"))

FAMILIES = {"basic": BASIC, "fractal": FRACTAL, "extrema": EXTREMA, "zone": MULTIZONE, "advanced": ADVANCED, "ct": COMPONENT_TREE}
ALL = tuple(c for names in FAMILIES.values() for c in names)
FROZEN = (*BASIC, *FRACTAL, *MULTIZONE)


_LESION, _INNER, _OUTER = ((*_multifractal(z), *_wavelet(z)) for z in ZONES)

#: Named groups of columns (fixed values: the names that studies use, and what they hold).
GROUPS: dict[str, tuple[str, ...]] = {
    # single families
    "basic": BASIC,
    "fractal": FRACTAL,
    "extrema": EXTREMA,
    "extrema_full": EXTREMA,
    "extrema_compact": EXTREMA_COMPACT,
    "multizone_extrema": MULTIZONE,
    # families beside each other
    "basic_fractal": (*BASIC, *FRACTAL),
    "basic_extrema": (*BASIC, *EXTREMA),
    "basic_extrema_compact": (*BASIC, *EXTREMA_COMPACT),
    "fractal_extrema": (*FRACTAL, *EXTREMA),
    "fractal_extrema_compact": (*FRACTAL, *EXTREMA_COMPACT),
    "fused": (*BASIC, *FRACTAL, *EXTREMA),
    "fused_full": (*BASIC, *FRACTAL, *EXTREMA),
    "fused_compact": (*BASIC, *FRACTAL, *EXTREMA_COMPACT),
    "basic_margin_extrema": (*BASIC, *MARGIN),
    "basic_multizone_extrema": (*BASIC, *MULTIZONE),
    "fractal_multizone_extrema": (*FRACTAL, *MULTIZONE),
    "fused_multizone": FROZEN,
    # screens of the wide table
    "multifractal30": MULTIFRACTAL,
    "wavelet36": WAVELET,
    "shape10": SHAPE,
    "frozen98": FROZEN,
    "advanced76": ADVANCED,
    "frozen98_advanced": (*FROZEN, *ADVANCED),
    "frozen98_component_tree": (*FROZEN, *COMPONENT_TREE),
    "frozen98_multifractal": (*FROZEN, *MULTIFRACTAL),
    "frozen98_wavelet": (*FROZEN, *WAVELET),
    "frozen98_shape": (*FROZEN, *SHAPE),
    "frozen98_multifractal_shape": (*FROZEN, *MULTIFRACTAL, *SHAPE),
    # comparators with connected morphology
    "conventional": BASIC,
    "conv_fractal": (*BASIC, *FRACTAL),
    "fused_extrema": FROZEN,
    "component_tree": COMPONENT_TREE,
    "conv_component_tree": (*BASIC, *COMPONENT_TREE),
    "conv_fractal_component_tree": (*BASIC, *FRACTAL, *COMPONENT_TREE),
    "fused_extrema_component_tree": (*FROZEN, *COMPONENT_TREE),
    # factorial of three blocks
    "gf30": MULTIFRACTAL,
    "w36": WAVELET,
    "s10": SHAPE,
    "gfw66": (*MULTIFRACTAL, *WAVELET),
    "gfs40": (*MULTIFRACTAL, *SHAPE),
    "ws46": (*WAVELET, *SHAPE),
    "gfwb76": (*MULTIFRACTAL, *WAVELET, *SHAPE),
    # one zone of the advanced block, and all its texture
    "lesion22": _LESION,
    "inner22": _INNER,
    "outer22": _OUTER,
    "texture66": (*MULTIFRACTAL, *WAVELET),
    "all": ALL,
}
#: Sizes that the formats fix; checked when the module is read.
SIZES = {"basic": 24, "fractal": 11, "extrema": 59, "extrema_compact": 19, "multizone_extrema": 63, "fused": 94, "frozen98": 98, "advanced76": 76, "component_tree": 54, "texture66": 66} | {n: int("".join(filter(str.isdigit, n))) for n in GROUPS if n[-1].isdigit()}
for _name, _size in SIZES.items():
    if len(GROUPS[_name]) != _size or len(set(GROUPS[_name])) != _size:
        raise AssertionError(f"group {_name} has {len(GROUPS[_name])} columns, not {_size}")

_PREFIXES = (("basic_", "basic"), ("fractal_", "fractal"), ("extrema_", "extrema"), ("zone_", "multizone"), ("advanced_mf_", "multifractal"), ("advanced_wavelet_", "wavelet"), ("advanced_shape_", "shape"), ("ct_", "component_tree"))


def family_of(column: str) -> str:
    """The family of a feature column; KeyError for any other column."""
    for prefix, family in _PREFIXES:
        if column.startswith(prefix):
            return family
    raise KeyError(f"no family has the column {column}")


#: Families of the fused group in studies of their contribution.
CONTRIBUTIONS = {"basic_": "basic", "fractal_": "fractal", "zone_lesion_": "lesion_extrema", "zone_inner_": "inner_margin_extrema", "zone_outer_": "outer_margin_extrema"}


def contribution_of(column: str) -> str:
    """The contribution family of a column of the fused group; KeyError for any other."""
    for prefix, family in CONTRIBUTIONS.items():
        if column.startswith(prefix):
            return family
    raise KeyError(f"no contribution family has the column {column}")


def group_columns(columns: Iterable[str], group: str) -> list[str]:
    """The columns of a named group that a table has, in the table's order within the group's families.

    KeyError for an unknown group, ValueError if none is there or one is there twice.
    """
    if group not in GROUPS:
        raise KeyError(f"unknown feature group: {group}")
    have = list(columns)
    chosen = [c for c in GROUPS[group] if c in set(have)]
    if not chosen:
        raise ValueError(f"the table has no column of group {group}")
    twice = [c for c in chosen if have.count(c) > 1]
    if twice:
        raise ValueError(f"columns occur twice: {twice}")
    return chosen


def require_same(first: Sequence[str], second: Sequence[str]) -> None:
    """ValueError unless two tables' feature columns are the same in the same order."""
    if list(first) != list(second):
        raise ValueError(f"feature columns differ: {sorted(set(first) ^ set(second))[:5] or 'in order'}")
