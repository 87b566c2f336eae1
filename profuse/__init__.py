"""profuse: combine several feature profiles of the same samples on Spark.

Every operator is a ``DataFrame -> DataFrame`` function or a fit/transform pair
whose fitted state is small.  Cells travel in one long layout,
``(profile, sample_id, feature, value)``, until a model needs dense vectors.
"""
