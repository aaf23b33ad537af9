"""tablemill: table-level analytics operators for Spark.

Every public operator takes DataFrames and returns a DataFrame. The modules:

``skew``        splitting hot groups: running totals, bounded windows, exact quantiles
``sources``     scans, exports, snapshots, upserts, page tables
``functions``   scalar Column expressions (numbers, text, time)
``operators``   filters, joins, aggregates, windows, series, checks, sampling, ranking
``modeling``    feature preparation, training and evaluation tables on ``pyspark.ml``
``plans``       complete jobs composed from the operators
``registry``    the named queries over the test tables, with their SQL
"""
