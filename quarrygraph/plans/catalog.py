"""Every query of the library by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .graph_catalog import ORACLE_SQL as GRAPH_SQL
from .graph_catalog import QUERIES as GRAPH
from .text_catalog import ORACLE_SQL as TEXT_SQL
from .text_catalog import QUERIES as TEXT

QUERIES = {**GRAPH, **TEXT}
ORACLE_SQL = {**GRAPH_SQL, **TEXT_SQL}
