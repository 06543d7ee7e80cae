"""Business operators: DataFrame(s) + parameters -> DataFrame.

Inputs use the reference column names (``tillroll.sources.schemas``).
Every operator is lazy; nothing is collected to the driver.
"""
