"""itemspace: survey cleaning, subject embedding, clustering sweeps and run
comparison expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
