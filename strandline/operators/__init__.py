from strandline.operators import facets, graphs, lookups, terms
from strandline.operators.pivots import PivotSet

__all__ = ["PivotSet", "facets", "graphs", "lookups", "terms"]
