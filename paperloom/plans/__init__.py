"""The registered queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from . import citing, media, reconcile, records, remote, states  # noqa: F401 they register theirs
from .library import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
