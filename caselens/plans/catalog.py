"""All registered queries."""

from caselens.plans import cleaning, clusters, labelling, retrieval, streams, trends  # noqa: F401
from caselens.plans.registry import QUERIES, SQL  # noqa: F401
