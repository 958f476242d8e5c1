"""millwright: a Spark-first engine for turning noisy measurements into audited results."""

__version__ = "0.1.0"
