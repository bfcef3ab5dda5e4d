"""tidegate - point-in-time cohort tables, text retrieval and model evaluation on Spark."""

__version__ = "0.1.0"
