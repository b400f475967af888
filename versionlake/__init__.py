"""versionlake: finding versions of the same work in large tables of recordings or texts, on PySpark."""

__version__ = "0.1.0"
