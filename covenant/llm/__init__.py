"""Training-data operators.

Nothing else in the library imports this subpackage; deleting it (together with
``tests/llm`` and ``corpus_pipeline.py``) leaves the relational engine whole.
"""
