"""Named queries over the test tables, each with the SQL that gives the same rows."""

from tablemill.registry import (  # noqa: F401  (importing fills the tables)
    aggregates,
    columns,
    evaluation,
    features,
    filters,
    joins,
    plans,
    ranking,
    sampling,
    series,
    sources,
    windows,
)
from tablemill.registry.base import QUERIES, SQL  # noqa: F401
