"""All registered queries of the analytics operators."""

from . import figures, metrics, models, prep, reports, schema, sources, stress  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
