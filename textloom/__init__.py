"""textloom: shrink, classify, protect and measure text artefacts on Spark.

Operators are functions from DataFrame (or Column) to DataFrame (or Column);
nothing here starts a session or collects data of unbounded size.
"""
