from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from strandline import Corpus, PivotSet  # noqa: E402
from strandline import schema as S  # noqa: E402
from strandline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app_name="strandline-tests",
        master="local[4]",
        shuffle_partitions=4,
        **{
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("test tables not present")
    return str(folder)


def pivot_row(direction, beta, topic_id, **values):
    row = dict(
        direction=direction,
        beta=beta,
        topic_id=topic_id,
        start_year=2000,
        end_year=2004,
        liveliness=2,
        split_degree=1.5,
        convergence_degree=1.25,
        relative_evolution=0.4,
        pivot_evolution=0.6,
        stable=[],
        emerging=[],
        decaying=[],
        specific=[],
    )
    unknown = set(values) - set(row)
    assert not unknown, unknown
    row.update(values)
    return tuple(row[c] for c in S.PIVOT_COLUMNS)


@pytest.fixture(scope="session")
def make_corpus(spark):
    """Build a corpus from plain rows; tables not given are empty."""
    schemas = {
        "pivots": S.PIVOTS,
        "paths": S.PATHS,
        "labels": S.LABELS,
        "individuals": S.INDIVIDUALS,
        "topic_nodes": S.TOPIC_NODES,
        "topic_dictionary": S.TOPIC_DICTIONARY,
        "vocabulary": S.VOCABULARY,
        "similarity_links": S.SIMILARITY_LINKS,
    }

    def make(**rows) -> Corpus:
        return Corpus.of(
            **{
                name: spark.createDataFrame(list(rows.get(name, [])), schema)
                for name, schema in schemas.items()
            }
        )

    return make


@pytest.fixture(scope="session")
def make_pivots(make_corpus):
    def make(*pivot_rows, **tables) -> PivotSet:
        return PivotSet.load(make_corpus(pivots=pivot_rows, **tables))

    return make


def keys(pivots: PivotSet):
    """Sorted (direction, beta, topic_id) of a pivot set, copies included."""
    rows = pivots.rows.select("direction", "beta", "topic_id").collect()
    return sorted(tuple(r) for r in rows)


def values(df):
    def plain(value):
        return tuple(value) if isinstance(value, list) else value

    return sorted((tuple(plain(v) for v in row) for row in df.collect()), key=repr)
