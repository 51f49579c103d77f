"""episodic: event-history prediction on Spark.

Episodes, next-event labels, point-in-time history features, temporal folds,
leakage-safe preprocessing, MLlib model grids, top-fraction metrics, fairness
crosstabs and model selection, all as DataFrame / window / MLlib jobs.
"""

__version__ = "0.1.0"
