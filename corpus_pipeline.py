"""The corpus pipeline of castmill.llm, by the name that drivers look for."""

from castmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
