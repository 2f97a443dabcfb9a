"""Named queries with the SQL that states their expected result."""

from __future__ import annotations

from ledgermatch.fixtures import with_clause
from ledgermatch.workload import checks, derived, estate, relational

QUERIES = {
    **checks.registry.queries,
    **relational.registry.queries,
    **derived.QUERIES,
    **estate.QUERIES,
}
ORACLE = {
    name: with_clause(sql.strip())
    for name, sql in {
        **checks.registry.sql,
        **relational.registry.sql,
        **derived.ORACLE,
        **estate.ORACLE,
    }.items()
}
