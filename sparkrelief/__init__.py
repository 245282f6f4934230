"""sparkrelief: terrain tiles as DataFrames.

A Spark-first engine for digital-elevation tiles: geodesy and tiling maths,
RGB height codecs, RTIN meshing, quantised-mesh tiles, normals, resampling and
manifests, all as Column and DataFrame expressions.  Bytes are packed only at
the edge, in Arrow batches.
"""
