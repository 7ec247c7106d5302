"""All queries of the core and their SQL twins."""

from tracelake.plans import batches, build, evaluating, losses, more, numerics, scores, similarity, training  # noqa: F401
from tracelake.plans.registry import QUERIES, SQL  # noqa: F401
