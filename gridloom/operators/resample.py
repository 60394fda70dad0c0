"""The entry point: moves a frame to another grid by whichever operation the two grids call for."""

from __future__ import annotations

from typing import Any

from ..plans.grid import GridMapping
from ..plans.options import LOG
from ..sources.frame import GridFrame
from .affine import affine_transform_dataset
from .rectify import rectify_dataset
from .reproject import reproject_dataset


def resample_in_space(source: GridFrame, target_gm: GridMapping | None = None, source_gm: GridMapping | None = None, *, variables: Any = None, interp_methods: Any = None, agg_methods: Any = None, recover_nans: Any = False, fill_values: Any = None, tile_size: Any = None) -> GridFrame:
    """A frame on the target grid.

    Irregular sources are rectified; sources of the same reference system are transformed affinely, and others
    reprojected.  A source that is on the target grid already, or has no target, is returned as it is.
    """
    grid = source_gm or source.grid
    options = {"variables": variables, "interp_methods": interp_methods, "agg_methods": agg_methods, "recover_nans": recover_nans, "fill_values": fill_values}
    if not grid.is_regular:
        return rectify_dataset(source, target_gm, grid, tile_size=tile_size, **options)
    if target_gm is None:
        LOG.warning("If source grid mapping is regular, target_gm must be given; the source is returned unchanged.")
        return source
    target_gm.assert_regular("target_gm")
    if grid.is_close(target_gm):
        return source
    if grid.crs.agrees(target_gm.crs):
        return affine_transform_dataset(source, target_gm, grid, **options)
    return reproject_dataset(source, target_gm, grid, **options)
