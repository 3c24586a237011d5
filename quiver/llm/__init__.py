"""Operators for preparing language-model training data.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it, so it can
be removed as a whole.  Each module holds one operator; ``queries`` registers
the thin ``opN_<name>`` queries over them.
"""
