"""feedloom: content-feed recommendation analytics as Spark jobs.

Every public function takes DataFrames and returns a DataFrame.  Catalyst plans
the work; Python runs only inside Arrow batches (blocked vector scoring, greedy
list diversification, attention pooling, streaming state).
"""

__version__ = "0.1.0"
