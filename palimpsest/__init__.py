"""palimpsest: cleaning, structuring and reviewing digitised book text with Spark."""

__version__ = "0.1.0"
