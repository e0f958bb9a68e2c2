"""The corpus pipeline: quality, line dedup, near duplicates, mixing, tokens.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and all that
its predecessor kept. ``run(spark, sf_dir)`` applies them to the table ``documents``.
"""

from evidencelake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
