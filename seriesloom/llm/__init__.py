"""Operators for preparing language-model training data at cluster scale.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; scratch tables go to the shared folder named by
``spark.checkpoint.dir`` (see :mod:`seriesloom.llm.scratch`).
"""
