"""Semi-supervised text classification as Spark jobs.

Documents become hashed term counts, a length-normalised Naive Bayes is fitted
as a grouped aggregate, and unlabelled documents improve it by expectation
maximisation.  Every step is a DataFrame expression; see README.md for the map.
"""

__version__ = "0.1.0"
