"""The library's queries by name and their SQL."""

from . import ordered, streamed  # noqa: F401  (they register their queries)
from .oracles import ORACLE_SQL as _SQL
from .ordered_sql import SQL
from .queries import Q
from .streamed_sql import SQL as STREAMED

FLAGSHIP = "reason_counts"
QUERIES = dict(Q)
ORACLE_SQL = {k: v for k, v in (_SQL | SQL | STREAMED).items() if k in QUERIES}
