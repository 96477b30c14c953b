"""Operations of a large-scale training-data pipeline, built on Spark.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library intact.
"""
