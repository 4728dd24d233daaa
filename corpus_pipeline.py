"""A training corpus from raw documents; the stages are in spillway.llm.pipeline."""

from spillway.llm.pipeline import MARGIN, ORACLE_SQL, STAGES, run

__all__ = ["MARGIN", "ORACLE_SQL", "STAGES", "run"]
