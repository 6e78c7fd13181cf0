"""Scalar expressions of the codec: transforms, prediction, quantizing, differencing, indexes, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-30
LOG_FIELDS = ("rho", "u")


def single(x: Column) -> Column:
    """Rounded to single precision, held as a double: one rounding after a double operation is that of the single one."""
    return x.cast("float").cast("double")


def transformed(x: Column) -> Column:
    """Log space of a positive field, in single precision."""
    return single(F.ln(F.greatest(single(x), F.lit(EPS))))


def inverse_transformed(x: Column) -> Column:
    return single(F.exp(single(x)))


def linear(start: Column, end: Column, tau: Column) -> Column:
    """Value at ``tau`` on the line between two anchors."""
    return (F.lit(1.0) - tau) * start + tau * end


def predicted_line(start: Column, end: Column, tau: Column) -> Column:
    """The same in single precision: weights, products and their sum are rounded each."""
    return single(single(single(F.lit(1.0) - tau) * start) + single(single(tau) * end))


def tau_of(time: Column, start: Column, end: Column) -> Column:
    return (time - start) / (end - start)


def top_code(bits: int) -> int:
    """Largest code of a signed quantizer; bits are 4 to 16."""
    if not 4 <= bits <= 16:
        raise ValueError("bits must be between 4 and 16")
    return 2 ** (bits - 1) - 1


def quantized(residual: Column, scale: Column, bits: int) -> Column:
    """Nearest code, ties to even, clipped."""
    q = top_code(bits)
    return F.greatest(F.lit(-q), F.least(F.lit(q), F.rint(single(residual / scale)).cast("int")))


def is_exception(residual: Column, scale: Column, bits: int, percentile: float) -> Column:
    """Whether the unrounded ratio leaves the code range; only below the 100th percentile are such values kept."""
    return (F.abs(single(residual / scale)) > top_code(bits)) if percentile < 100 else F.lit(False)


def dequantized(code: Column, scale: Column, exception: Column | None = None) -> Column:
    """Residual of a code; a kept exact value replaces it."""
    value = single(code.cast("double") * scale)
    return value if exception is None else F.coalesce(exception, value)


def wrapped(difference: Column, bits: int = 8) -> Column:
    """Two's-complement wrap of an integer difference."""
    half = 2 ** (bits - 1)
    return F.pmod(difference + half, F.lit(2 * half)) - half


def zigzag(signed: Column) -> Column:
    """0, -1, 1, -2 ... as 0, 1, 2, 3 ..."""
    return F.when(signed >= 0, signed * 2).otherwise(-signed * 2 - 1)


def unzigzag(code: Column) -> Column:
    return F.when(code % 2 == 0, F.floor(code / 2)).otherwise(-F.floor((code + 1) / 2))


def packed_nibbles(codes: Column) -> Column:
    """Signed 4-bit codes two to a byte, +8, low nibble first; odd lengths get a zero nibble."""
    at = F.sequence(F.lit(0), F.greatest(F.floor((F.size(codes) + 1) / 2) - 1, F.lit(0)))
    low = lambda k: F.get(codes, k * 2).cast("int") + 8
    high = lambda k: F.coalesce(F.get(codes, k * 2 + 1).cast("int") + 8, F.lit(0))
    return F.when(F.size(codes) > 0, F.transform(at, lambda k: low(k).bitwiseOR(F.shiftleft(high(k), 4)))).otherwise(F.array().cast("array<int>"))


def unpacked_nibbles(packed: Column, size: Column) -> Column:
    every = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(F.lit(15)) - 8, F.shiftright(b, 4).bitwiseAND(F.lit(15)) - 8)))
    return F.slice(every, 1, size)


def tile_of(index: Column, shape: tuple[int, int, int], tile: tuple[int, int, int]) -> Column:
    """Tile number of a flat cell index in (phi, theta, r) order; a tile must divide the shape."""
    if any(n % t for n, t in zip(shape, tile, strict=True)):
        raise ValueError("tile must divide shape")
    r, theta, phi = index % shape[2], F.floor(index / shape[2]) % shape[1], F.floor(index / (shape[1] * shape[2]))
    across = shape[1] // tile[1], shape[2] // tile[2]
    return ((F.floor(phi / tile[0]) * across[0] + F.floor(theta / tile[1])) * across[1] + F.floor(r / tile[2])).cast("int")


def log_grid_cells(radius: Column, first: float, last: float, cells: int, halo: int = 1, alignment: int = 32) -> Column:
    """Cells of a logarithmic radial grid that cover ``radius``, with halo, rounded up to the alignment."""
    step = (last - first) / cells
    index = F.floor((F.ln(radius) - first) / step - 0.5) + 2 + halo
    return F.least(F.lit(cells), F.ceil(index / alignment) * alignment).cast("int")


def mebibytes(size: Column) -> Column:
    return size / F.lit(1048576.0)


def scheme_tag(bits: dict[str, int], percentiles: dict[str, float] | None = None) -> str:
    """Name of a bit and percentile allocation, such as ``q8_uvec5_Bp99p5``."""
    base = max(set(bits.values()), key=list(bits.values()).count)
    parts = [f"q{base}"] + [f"{k}{v}" for k, v in bits.items() if v != base]
    return "_".join(parts + [f"{k}p{v:g}".replace(".", "p") for k, v in (percentiles or {}).items()])
