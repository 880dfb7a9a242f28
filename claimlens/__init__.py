"""claimlens: Spark-native claim/text-pair classification analytics.

Every operator takes and returns a ``pyspark.sql.DataFrame`` and is built from
column expressions, aggregations, windows and joins, so Catalyst plans it and
the work is spread over the cluster.  Sub-packages:

* ``sources``   – table views, CSV/JSON/parquet readers and writers
* ``functions`` – column expressions (cleaning, n-grams, prompts, scoring)
* ``operators`` – relational operators (TF-IDF, splits, metrics, fits)
* ``plans``     – end-to-end studies composed from operators
* ``streaming`` – the row-wise operators on ``readStream`` input
"""

__version__ = "0.1.0"
