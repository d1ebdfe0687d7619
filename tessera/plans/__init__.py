"""Named queries over the driver tables; importing this package fills the registry."""

from tessera.plans import (catalog_q, decide_q, drift_q, features_q, metrics_q, misc_q, ml_q,  # noqa: F401,I001
                           profile_q, sources_q, stream_q)
from tessera.plans.common import REGISTRY

__all__ = ["REGISTRY"]
