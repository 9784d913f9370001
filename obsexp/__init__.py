"""Observed-versus-expected analytics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame. Most are lazy. Model fits, file sinks and streams start
jobs, and so do operators that read one intermediate several times (ranks, quantiles, AUC, shrinkage): they write it
once to the shared folder and continue from there.
"""

__version__ = "0.1.0"
