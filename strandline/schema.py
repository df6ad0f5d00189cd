"""Column names and schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql import types as T

FUTURE, PAST = "future", "past"
DIRECTIONS = (FUTURE, PAST)

LABEL_KINDS = ("stable", "emerging", "decaying", "specific")
METRICS = (
    "liveliness",
    "split_degree",
    "convergence_degree",
    "relative_evolution",
    "pivot_evolution",
)

_TERMS = T.ArrayType(T.StringType())


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


# --- canonical tables -------------------------------------------------------

PIVOTS = _struct(
    direction=T.StringType(),
    beta=T.DoubleType(),
    topic_id=T.LongType(),
    start_year=T.IntegerType(),
    end_year=T.IntegerType(),
    liveliness=T.IntegerType(),
    split_degree=T.DoubleType(),
    convergence_degree=T.DoubleType(),
    relative_evolution=T.DoubleType(),
    pivot_evolution=T.DoubleType(),
    stable=_TERMS,
    emerging=_TERMS,
    decaying=_TERMS,
    specific=_TERMS,
)

# One row per edge tj -> tk of the graph of root ti; ``beta`` is the threshold of
# the graph and ``sim`` the weight of the edge.  In past graphs tj is the topic
# nearer the root and tk the older one.
PATHS = _struct(
    direction=T.StringType(),
    beta=T.DoubleType(),
    ti=T.LongType(),
    tj=T.LongType(),
    tk=T.LongType(),
    pj=T.IntegerType(),
    pk=T.IntegerType(),
    sim=T.DoubleType(),
)

LABELS = _struct(
    beta=T.DoubleType(),
    ti=T.LongType(),
    stable=_TERMS,
    emerging=_TERMS,
    decaying=_TERMS,
    specific=_TERMS,
)

TOPIC_NODES = _struct(
    topic_id=T.LongType(),
    period=T.StringType(),
    weight=T.DoubleType(),
    term=T.StringType(),
)

TOPIC_DICTIONARY = _struct(topic_id=T.LongType(), terms=_TERMS)
VOCABULARY = _struct(id=T.LongType(), term=T.StringType())
SIMILARITY_LINKS = _struct(s=T.LongType(), t=T.LongType(), sim=T.DoubleType())
PERIODS = _struct(period=T.StringType(), period_idx=T.IntegerType())
INDIVIDUALS = _struct(
    beta=T.DoubleType(), topic_id=T.LongType(), terms=_TERMS, period_idx=T.IntegerType()
)

#: Columns that name a row and are never NULL; columns that a stored table may lack.
_KEYS = ("topic_id", "ti", "tj", "tk", "id", "s", "t")
OPTIONAL = ("term",)

PIVOT_COLUMNS = PIVOTS.fieldNames()
PATH_COLUMNS = PATHS.fieldNames()
LABEL_COLUMNS = LABELS.fieldNames()

# --- column names of exported corpus directories (fixed values) --------------
# canonical name -> name in the stored files

EXPORTED_PIVOTS = {
    "beta": "Beta",
    "topic_id": "TopicID",
    "start_year": "Startyear",
    "end_year": "Endyear",
    "liveliness": "Liveliness",
    "split_degree": "SplitDegree",
    "convergence_degree": "ConvergenceDegree",
    "relative_evolution": "RelativeEvolutionDegree",
    "pivot_evolution": "PivotEvolutionDegree",
    "stable": "stable",
    "emerging": "emerging",
    "decaying": "decaying",
    "specific": "specific",
}
EXPORTED_PATHS = {"ti": "Ti", "tj": "Tj", "tk": "Tk", "pj": "Pj", "pk": "Pk", "sim": "Beta"}
EXPORTED_LABELS = {"ti": "Ti", **{kind: kind for kind in LABEL_KINDS}}
EXPORTED_TOPIC_NODES = {
    "topic_id": "idTopic",
    "period": "period",
    "weight": "weight",
    "term": "term",
}
EXPORTED_TOPIC_DICTIONARY = {"topic_id": "idTopic", "terms": "topic"}
EXPORTED_VOCABULARY = {"id": "id", "term": "term"}
EXPORTED_SIMILARITY_LINKS = {"s": "s", "t": "t", "sim": "sim"}
EXPORTED_INDIVIDUALS = {"topic_id": "id", "terms": "topic", "period_idx": "period"}


# --- names of the SQL views over an exported corpus (fixed values) -----------
VIEW_TOPIC_NODES = "topicNodes"
VIEW_TOPIC_DICTIONARY = "topicDictionary_unique_10"
VIEW_LABELS = "labels"
VIEW_TOPIC_PERIOD = "topicPeriod"
VIEW_FREQUENT = "freqLabels"
VIEW_PER_PERIOD = "labelPerPeriod"


def keys_of(canonical: T.StructType) -> list[str]:
    return [c for c in canonical.fieldNames() if c in _KEYS]


def exported_schema(canonical: T.StructType, names: dict[str, str]) -> T.StructType:
    """Schema of a stored file: the canonical types under the stored names."""
    return T.StructType([T.StructField(names[c], canonical[c].dataType) for c in names])
