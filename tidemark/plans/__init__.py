"""All queries of the engine and the SQL that they are compared with."""

from . import data, decisions, features, pipelines
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "data", "decisions", "features", "pipelines"]
