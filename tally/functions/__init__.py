"""Scalar column expressions (E1-E21) and name-level projections."""

from tally.functions.exprs import *  # noqa: F401,F403
from tally.functions.columns import *  # noqa: F401,F403
