"""Perturbations of an image or its mask, and crops for embedding models.

A condition is an entry of ``_ON_IMAGE`` or ``_ON_MASK``: a function of arrays.  A view
is an entry of ``_SHOWN``: the part of a lesion that stays visible in its crop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from lumenlake.functions import raster

# Constants of the conditions, of the boundary field and of the crops.
SPECKLE, DISK = 0.05, 3
SMOOTHNESS, LEAST_SIGMA, LEAST_RADIUS = 0.06, 2.0, 4.0
HOLES, LEAST_HOLE = 0.002, 16
LEAST_LESION, OUTER_DISK, INNER_DISK = 32, 12, 2


def seed_of(*parts: object) -> int:
    """The first 8 bytes, little-endian, of the SHA-256 of the parts joined by bars."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "little")


def _tone(curve: Callable[[np.ndarray, np.random.Generator], np.ndarray]) -> Callable:
    """A condition that maps intensities in 0..1; back in 8 bits they are cut off, not rounded."""

    def run(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return np.clip(curve(image / 255.0, rng) * 255.0, 0.0, 255.0).astype(np.uint8)

    return run


def _halved(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    small = tuple(max(1, side // 2) for side in image.shape)
    return raster.resize_u8(raster.resize_u8(image, small), image.shape)


_ON_IMAGE: dict[str, Callable] = {
    "downsample_50": _halved,
    "speckle_005": _tone(lambda v, rng: v * (1 + rng.normal(0.0, SPECKLE, v.shape))),
    "gamma_08": _tone(lambda v, rng: v**0.8),
    "gamma_12": _tone(lambda v, rng: v**1.2),
}
_ON_MASK: dict[str, Callable] = {
    "mask_erode_3": lambda inside: raster.erode(inside, DISK),
    "mask_dilate_3": lambda inside: raster.dilate(inside, DISK),
}
CONDITIONS = (*_ON_IMAGE, *_ON_MASK)


def perturb(image: np.ndarray, mask: np.ndarray, dataset: str, name: str, condition: str) -> tuple[np.ndarray, np.ndarray]:
    """An 8-bit image and its mask under a named condition; KeyError for any other name.

    Random conditions draw from a seed of (dataset, name, condition).
    """
    if condition not in CONDITIONS:
        raise KeyError(f"{condition} is none of {', '.join(CONDITIONS)}")
    pixels = np.asarray(image).astype(np.uint8)
    if condition in _ON_MASK:
        return pixels, _ON_MASK[condition](np.asarray(mask) > 0).astype(np.uint8)
    return _ON_IMAGE[condition](pixels, np.random.default_rng(seed_of(dataset, name, condition))), mask


def changed_mask(mask: np.ndarray, condition: str) -> np.ndarray:
    """An eroded or dilated mask (disk 3); KeyError for another condition, ValueError if nothing is left."""
    out = _ON_MASK[condition](np.asarray(mask) > 0).astype(np.uint8)
    if out.max(initial=0) == 0:
        raise ValueError(f"nothing is left of the mask under {condition}")
    return out


def main_component(mask: np.ndarray) -> np.ndarray:
    """The largest component without holes smaller than max(16, 0.2 % of it)."""
    part = raster.largest(mask)
    return raster.fill_small_holes(part, max(LEAST_HOLE, int(HOLES * part.sum())))


@lru_cache(maxsize=8)
def unit_field(shape: tuple[int, int], sigma: float, seed: int) -> np.ndarray:
    """Smoothed white noise with mean 0 and deviation 1; all zero where smoothing leaves none.  Not to be changed: amplitudes share it."""
    noise = raster.smooth(np.random.default_rng(seed).normal(size=shape), sigma, "symmetric")
    noise -= noise.mean()
    deviation = float(noise.std())
    return noise / deviation if deviation > 1e-8 else np.zeros(shape)


def signed_depth(inside: np.ndarray) -> np.ndarray:
    """Distance to the boundary, negative outside."""
    return raster.distance_to(inside) - raster.distance_to(~inside)


@lru_cache(maxsize=8)
def _depth(bits: bytes, shape: tuple[int, int]) -> np.ndarray:
    """``signed_depth`` of packed bits; all jitters of a mask share it."""
    return signed_depth(np.unpackbits(np.frombuffer(bits, np.uint8), count=shape[0] * shape[1]).astype(bool).reshape(shape))


def jitter(mask: np.ndarray, amplitude: float, seed: int, name: str) -> np.ndarray:
    """The mask with its boundary moved by a smooth random field, in units of its equivalent radius.

    ValueError for masks of an equivalent radius under LEAST_RADIUS, and where the field is flat.
    """
    inside = np.asarray(mask) > 0
    radius = float(np.sqrt(np.count_nonzero(inside) / np.pi))
    if radius < LEAST_RADIUS:
        raise ValueError(f"an equivalent radius of {radius:.1f} pixels is too small")
    field = unit_field(inside.shape, max(LEAST_SIGMA, SMOOTHNESS * radius), seed_of(seed, name) % (2**32 - 1))
    if not field.any():
        raise ValueError("no field on this mask")
    return main_component(_depth(np.packbits(inside).tobytes(), inside.shape) > -amplitude * radius * field).astype(np.uint8)


def _box(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row and column of a part."""
    sides = [np.flatnonzero(part.any(axis=1 - k)) for k in (0, 1)]
    if not len(sides[0]):
        raise ValueError("nothing is marked")
    return np.array([s[0] for s in sides]), np.array([s[-1] for s in sides])


def _widened(part: np.ndarray, by) -> tuple[slice, slice]:
    """The box of a part, widened on all sides and cut at the border."""
    low, high = _box(part)
    return tuple(slice(int(a), int(b)) for a, b in zip(np.maximum(low - by, 0), np.minimum(high + by + 1, part.shape), strict=True))


def square_crop(image: np.ndarray, mask: np.ndarray, expansion: float = 0.12, side: int = 224) -> np.ndarray:
    """The mask's bounding box, widened on each axis by its share (two pixels at least), as an 8-bit square."""
    part = np.asarray(mask) > 0
    low, high = _box(part)
    margin = np.maximum(2, np.rint(expansion * (high - low + 1)).astype(int))
    return raster.resize_u8(np.asarray(image)[_widened(part, margin)], (side, side))


def _core(lesion: np.ndarray, outer: np.ndarray) -> np.ndarray:
    inner = raster.erode(lesion, INNER_DISK)
    return inner if np.count_nonzero(inner) >= LEAST_LESION else lesion


#: Of each view the part that is shown, of the lesion and its dilation; None shows all.
_SHOWN: dict[str, Callable | None] = {"roi_context": None, "lesion_only": lambda lesion, outer: lesion, "inner_only": _core, "lesion_outer": lambda lesion, outer: outer}
VIEWS = tuple(_SHOWN)


def view(image: np.ndarray, mask: np.ndarray, name: str, margin: int = 4) -> np.ndarray:
    """A crop around the dilated lesion (disk 12), for some views with the median of what is shown elsewhere.

    ValueError for another view, a lesion under LEAST_LESION pixels or arrays that do not lie on each other.
    """
    if name not in _SHOWN:
        raise ValueError(f"{name} is none of {', '.join(VIEWS)}")
    part = _SHOWN[name]
    pixels, lesion = np.asarray(image).astype(np.uint8), np.asarray(mask) > 0
    if pixels.shape != lesion.shape or np.count_nonzero(lesion) < LEAST_LESION:
        raise ValueError(f"no lesion of {LEAST_LESION} pixels on an image of shape {pixels.shape}")
    outer = raster.dilate(lesion, OUTER_DISK)
    at = _widened(outer, margin)
    crop = pixels[at].copy()
    if part is not None:
        shown = part(lesion[at], outer[at])
        crop[~shown] = int(np.median(crop[shown]))
    return crop
