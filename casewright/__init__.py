"""casewright: investigation analytics on Spark DataFrames.

Every operator is a function from DataFrames to DataFrames; nothing is
collected to the driver unless a docstring says so and names the bound.
"""

__version__ = "0.1.0"
