"""Radial regions of interest on a logarithmic grid: how many cells to keep, and when that is refused."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Grid:
    """A radial grid, uniform in the logarithm from ``first`` to ``last``; ``block`` is the radial size of a block."""

    first: float
    last: float
    cells: int
    block: int
    transform: str = "fmks"
    refinement: str = "none"
    ratio: float = 1.0


@dataclass(frozen=True)
class Region:
    cells: int
    last: float
    spacing: float


def radial_region(grid: Grid, radius: float, halo: int = 1, alignment: int = 32) -> Region:
    """Cells from the inner edge that cover ``radius`` with its halo, and an outer edge that keeps the spacing bit for bit.

    Everything that would move a cell is an error: refined or stretched grids, several radial blocks, a radius off the grid,
    an outer edge for which no neighbouring number gives the same spacing.
    """
    if not math.isfinite(radius) or radius <= 0:
        raise ValueError("a region needs a finite positive radius")
    if halo < 1 or alignment < 1:
        raise ValueError("a region needs a halo and an alignment")
    if grid.transform not in ("fmks", "mks") or grid.refinement != "none" or grid.ratio != 1:
        raise ValueError("a region needs an unrefined logarithmic grid")
    if grid.block != grid.cells:
        raise ValueError("a region needs one radial block")
    spacing = (grid.last - grid.first) / grid.cells
    if not (math.isfinite(spacing) and spacing > 0):
        raise ValueError("a grid needs a positive spacing")
    if math.log(radius) < grid.first:
        raise ValueError("the region lies inside the grid's inner edge")
    upper = math.floor((math.log(radius) - grid.first) / spacing - 0.5) + 1
    cells = min(grid.cells, -(-max(1, upper + 1 + halo) // alignment) * alignment)
    if cells == grid.cells:
        return Region(cells, grid.last, spacing)
    edge = below = above = grid.first + cells * spacing
    near = [edge]
    for _ in range(4):
        below, above = math.nextafter(below, -math.inf), math.nextafter(above, math.inf)
        near += [below, above]
    for last in near:
        if (last - grid.first) / cells == spacing:
            return Region(cells, last, spacing)
    raise ValueError("no outer edge keeps the spacing")


def automatic_radius(parameters: dict[str, str]) -> float | None:
    """The outer radius that parameters ask for; none where it is not positive."""
    radius = float(parameters.get("outer_radius", -1))
    if not math.isfinite(radius):
        raise ValueError("the outer radius is not finite")
    return radius if radius > 0 else None


def hold_radius(effective: dict[str, str], served: float | None) -> None:
    """After a run: it must have stayed inside the region that was served."""
    if served is None:
        return
    radius = float(effective["outer_radius"])
    if not math.isfinite(radius) or not 0 < radius <= served:
        raise ValueError("a run went beyond the region that was served")
