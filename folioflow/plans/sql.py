"""The SQL of all queries."""

from . import oracle, oracle_models

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL | oracle_models.ORACLE_SQL
