"""All registered queries; importing the query modules fills the registry."""

from . import (  # noqa: F401
    diagnostic_queries,
    feature_queries,
    ingest_queries,
    model_queries,
    profile_queries,
    scan_queries,
    sequence_queries,
    source_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
