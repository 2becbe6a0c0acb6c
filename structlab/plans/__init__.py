"""Named queries over the test tables, each beside its DuckDB text."""

from structlab.plans import events, instruments, nullmodels, rasters, relational, roundtrips, sequences, space, texts  # noqa: F401
from structlab.plans.registry import ORACLES, QUERIES  # noqa: F401
