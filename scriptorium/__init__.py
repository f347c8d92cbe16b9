"""scriptorium - paper-metadata analytics on Spark.

DataFrame-in / DataFrame-out operators for extracting, reconciling, indexing
and searching scholarly-archive metadata.  See README.md.
"""

__version__ = "0.1.0"
