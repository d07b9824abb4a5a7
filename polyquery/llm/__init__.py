"""Operators for building language-model training corpora on Spark.

Nothing outside this package imports it. Every operator takes DataFrames and
returns DataFrames; the driver only ever holds bounded models, counts and
schemas. Tables that an operator has to reread are written below
``spark.checkpoint.dir``.
"""
