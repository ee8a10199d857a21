"""gridlab: gridded climate time-series features and presence/absence model
selection, expressed as Spark DataFrame / SQL / ML jobs.

Sub-packages
------------
sources    scans and sinks (cube, points, feature store, JSON, submissions)
functions  scalar column expressions (safe ratio, logit, blocks, grids)
operators  table operators (temporal, focal, joins, metrics, sampling, ...)
plans      end-to-end compositions (feature build, model suite, post-hoc)
streaming  none: the workload is batch only (see README)
"""

__version__ = "0.1.0"
