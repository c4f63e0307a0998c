"""Training-data operators: each module holds one operator with its own general interface.

The thin ``opN_<name>`` queries over the synthetic tables are in :mod:`ledgerloom.llm.queries`,
their SQL counterparts in :mod:`ledgerloom.llm.oracles`.  Nothing outside this subpackage
imports it except the guarded hook in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
