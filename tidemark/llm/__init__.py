"""Operators for large training-data pipelines.

The package stands alone: nothing else in ``tidemark`` imports it.  Every
operator takes and returns DataFrames, keeps bulk data on the executors and
puts whatever must outlive a stage in the folder that ``spark.checkpoint.dir``
names, so that a lost executor costs a recomputation and never a result.
"""
