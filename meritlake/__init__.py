"""Certificate analytics as Spark jobs.

``functions``  Column -> Column building blocks (built-in expressions only)
``operators``  DataFrame -> DataFrame operators
``sources``    readers, writers and the partition-wise caller
``plans``      whole pipelines and the query catalogue
``streaming``  the same pipelines on arriving data
"""
