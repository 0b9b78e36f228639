"""ledgerloom: Spark-first analytics over portfolios of long-running projects.

Every operator is a pure function from DataFrames (and an explicit ``as_of``
date) to a DataFrame.  ``ledgerloom.llm`` holds the training-data operators; no
other module imports it.
"""
