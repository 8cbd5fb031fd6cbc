"""millrace: transaction tables to trustworthy model input and scores, on Spark."""

__version__ = "0.1.0"
