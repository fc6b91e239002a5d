"""sentiscope: reputation analytics on Spark.

Posts are ingested, cleaned and deduplicated, scored for sentiment, rolled up
into a daily weighted reputation index and served to monitoring views; the
least certain predictions go to human review, corrections come back as labels,
and a classifier is retrained, evaluated and gated. Every job is a function
``DataFrame -> DataFrame`` (or a small writer around one); no job holds a global
session.
"""

__all__ = ["session"]
