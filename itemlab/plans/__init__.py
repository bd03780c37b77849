"""Queries over the driver tables and their SQL twins."""

from . import content, exam, records

QUERIES = {**exam.QUERIES, **content.QUERIES, **records.QUERIES}
ORACLE_SQL = {**exam.ORACLE_SQL, **content.ORACLE_SQL, **records.ORACLE_SQL}
