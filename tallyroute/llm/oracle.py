"""DuckDB SQL of the queries that SQL can express.

The first ten hold a learnt verdict, a hash DuckDB lacks or a vocabulary; their tests compare them
with brute force.
"""

from tallyroute.llm import lexical_search

ORACLE_SQL: dict[str, str] = {"op11_lexical_search": lexical_search.ORACLE}
