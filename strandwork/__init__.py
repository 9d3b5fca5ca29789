"""strandwork: a Spark-first engine for curating, auditing, sampling and scoring sequence corpora."""

__version__ = "0.1.0"
