"""Training-data operators: thirteen corpus-scale operators on Spark DataFrames.

Nothing outside this subpackage imports it; `queries.py` registers the
`opN_*` queries and `corpus_pipeline.py` (repository top) chains five of them.
"""
