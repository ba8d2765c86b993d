"""Training-data operators: ten self-contained modules plus their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
