"""shoplens: client behaviour features and vectors as Spark DataFrame jobs.

Every public function takes and returns lazy DataFrames; nothing is
collected to the driver except one-row constants and fitted model
parameters of bounded size.
"""

__all__ = ["session", "sources", "functions", "operators", "plans"]
