"""tallymill: Spark-native analytics over predictors, raters, items and corpora."""

__version__ = "0.1.0"
