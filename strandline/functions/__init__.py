from strandline.functions.columns import (
    edge_strength,
    fixed_point_mean,
    in_range,
    joined,
    mentions,
    mentions_any,
    rounded_similarity,
    threshold_key,
)
from strandline.functions.joins import distinct_keys

__all__ = [
    "distinct_keys",
    "edge_strength",
    "fixed_point_mean",
    "in_range",
    "joined",
    "mentions",
    "mentions_any",
    "rounded_similarity",
    "threshold_key",
]
