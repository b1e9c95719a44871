"""The corpus pipeline: five stages over documents."""

from quern.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
