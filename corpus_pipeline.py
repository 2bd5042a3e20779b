"""A corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

The stages are in ``cloakwork.llm.pipeline``. Each takes ``(spark, docs,
sf_dir)`` and works on all that its predecessor kept; all but the last return
the columns of ``documents``.
"""

from cloakwork.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
