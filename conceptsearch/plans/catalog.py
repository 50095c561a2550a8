"""Every registered query and its oracle SQL, collected in one place."""

from conceptsearch.plans import registry  # noqa: F401  (first: defines QUERIES)
from conceptsearch.plans import queries_training, queries_sae, queries_text, queries_io  # noqa: F401
from conceptsearch.plans import oracle  # noqa: F401  (shared CTEs)
from conceptsearch.plans import oracle_training, oracle_sae, oracle_text, oracle_io  # noqa: F401

QUERIES = registry.QUERIES
ORACLE = oracle.ORACLE
