"""A Spark engine that moves gridded data between spatial grids."""

from .operators.affine import affine_transform_dataset
from .operators.rectify import rectify_dataset
from .operators.reproject import reproject_dataset
from .operators.resample import resample_in_space
from .plans.crs import CRS, CRS_CRS84, CRS_WGS84
from .plans.grid import GridMapping
from .sources.frame import GridFrame, clip_by_bbox

__version__ = "0.1.0"
__all__ = ["CRS", "CRS_CRS84", "CRS_WGS84", "GridFrame", "GridMapping", "affine_transform_dataset", "clip_by_bbox", "rectify_dataset", "reproject_dataset", "resample_in_space"]
