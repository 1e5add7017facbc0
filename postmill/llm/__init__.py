"""Operations of a large-scale training-data pipeline, as Spark jobs.

Nothing else in the package imports this subpackage.
"""
