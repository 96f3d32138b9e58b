"""Spark-native analytics on short documents, crosswalks and panels.

Every operator is a function from DataFrame to DataFrame; nothing is executed
until the caller acts on the result, except where a docstring says so.
"""

__version__ = "0.1.0"
