"""Veridrome: compliance analytics and training-data preparation on Spark.

Every operator takes DataFrames and returns DataFrames.  Nothing here runs a
job on import; the few operators that need a small action (a size check, a
merged schema) say so in their docstring.
"""

__version__ = "0.1.0"
