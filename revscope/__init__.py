"""Spark-native review analytics: profiling, TF-IDF + logistic regression,
evaluation, model comparison and retrieval QA as DataFrame operators."""

__version__ = "0.1.0"
