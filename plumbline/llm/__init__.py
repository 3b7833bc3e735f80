"""Training-data operators: one module per operator, each usable on any DataFrame.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
