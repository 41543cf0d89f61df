"""Labelled-raster measurement and quality control on Spark DataFrames.

Every table carries ``field_id`` (one imaged field of view) and, for rasters,
``y``/``x`` (0-based, origin top-left) plus ``height``/``width``.
"""

__version__ = "0.1.0"
