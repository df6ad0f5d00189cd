"""Topic-evolution analytics as Spark DataFrame plans.

Topics are mined per time period; similar topics of adjacent periods are linked.
A *pivot* is a topic seen together with its future graph (what it turns into) or
its past graph (where it comes from) at one similarity threshold ``beta``.
``PivotSet`` is an immutable algebra over sets of pivots; the other modules give
term reports, facets and graph tables over the same corpus.
"""

from strandline.operators.pivots import PivotSet
from strandline.sources.corpus import Corpus

__all__ = ["Corpus", "PivotSet"]
