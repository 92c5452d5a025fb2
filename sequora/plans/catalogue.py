"""All registered queries: name to function, and name to SQL."""

from __future__ import annotations

from sequora.plans import distributions, kernels, relational, resampling, transitions, windows  # noqa: F401
from sequora.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
