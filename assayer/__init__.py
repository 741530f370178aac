"""Assayer: preparation and analysis of compound tables on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Sub-packages:

``sources``    readers and sinks
``functions``  column expressions (hashing, structure strings, set scores)
``operators``  cleaning, features, splits, profiling, search, model metrics
``streaming``  the stateful and windowed event aggregates
``plans``      compositions of operators, and the checked queries
"""
