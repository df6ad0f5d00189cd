from __future__ import annotations

import json

import pytest
from conftest import pivot_row, values

from strandline import Corpus, PivotSet
from strandline import schema as S
from strandline.plans.export import export_corpus
from strandline.sources import (
    ExportedLayout,
    Workspace,
    check_columns,
    open_exported,
    read_table,
    shared_folder,
)
from strandline.sources.corpus import TABLES

F_, P_ = S.FUTURE, S.PAST


@pytest.fixture(scope="module")
def corpus(make_corpus):
    return make_corpus(
        pivots=[
            pivot_row(F_, 0.3, 1, stable=["a"], emerging=None, split_degree=1 / 3),
            pivot_row(P_, 0.5, 2, specific=[]),
        ],
        paths=[
            (F_, 0.3, 1, 1, 11, 0, 1, 0.1 + 0.2),
            (F_, 0.5, 1, 1, 12, 0, 1, 0.6),
            (P_, 0.5, 12, 12, 1, 1, 0, 0.6),
        ],
        labels=[(0.3, 1, ["a"], [], None, ["b", "c"]), (0.5, 1, [], [], [], [])],
        individuals=[(0.5, 9, ["d"], 0)],
        topic_nodes=[(1, "1998-2000", 2.5, "a")],
        topic_dictionary=[(1, ["a", "b"])],
        vocabulary=[(7, "a")],
        similarity_links=[(1, 11, 0.25)],
    )


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_exported_directories_read_back_equal(spark, corpus, tmp_path, fmt):
    layout = ExportedLayout(str(tmp_path), betas=(0.3, 0.5), topics_per_period=20, fmt=fmt)
    tables = [t for t in TABLES if t != "periods"]
    export_corpus(corpus, layout, tables)
    assert (tmp_path / "evolutionPath" / "0.5_20_0.0_10" / "past").is_dir()
    back = open_exported(spark, layout)
    for table in tables:
        assert values(back.table(table)) == values(corpus.table(table)), table
        assert back.table(table).columns == corpus.table(table).columns
    assert PivotSet.load(back).emerge("a").rows.count() == 0


def test_only_the_wanted_threshold_is_opened(spark, corpus, tmp_path):
    layout = ExportedLayout(str(tmp_path), betas=(0.3, 0.5), topics_per_period=20)
    export_corpus(corpus, layout, ["paths"])
    one = open_exported(spark, layout).paths(0.5, F_)
    assert one.count() == 1
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # the other three directories are gone from the plan


def test_parquet_with_other_number_types_is_cast(spark, tmp_path):
    stored = spark.createDataFrame([(1, "x", 3)], "idTopic int, period string, weight long")
    stored.write.parquet(str(tmp_path / "n"))
    back = read_table(
        spark, str(tmp_path / "n"), "parquet", S.TOPIC_NODES, S.EXPORTED_TOPIC_NODES, optional=S.OPTIONAL
    )
    assert values(back) == [(1, "x", 3.0, None)]
    assert back.schema["topic_id"].dataType == S.TOPIC_NODES["topic_id"].dataType


def read_json(spark, folder, lines):
    (folder / "n.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return read_table(
        spark, str(folder / "n.json"), "json", S.TOPIC_NODES, S.EXPORTED_TOPIC_NODES, S.keys_of(S.TOPIC_NODES)
    )


def test_json_needs_no_inference_and_tolerates_missing_values(spark, tmp_path):
    back = read_json(spark, tmp_path, [{"idTopic": 4, "period": "p"}, {"weight": 0.5, "idTopic": 5, "extra": 1}])
    assert values(back) == [(4, "p", None, None), (5, None, 0.5, None)]
    check_columns(back, ["period", "weight"])
    with pytest.raises(ValueError, match="term"):
        check_columns(back, ["period", "term"])


def test_json_errors_are_not_turned_into_null(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        read_json(spark, tmp_path, [{"idTopic": 4}, '{"idTopic": 5, '] ).collect()
    with pytest.raises(Exception, match="without idTopic"):
        read_json(spark, tmp_path, [{"idTopic": 4}, {"topic": 5}]).collect()


def test_a_missing_parquet_column_is_refused(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "idTopic int, period string").write.parquet(str(tmp_path / "n"))
    with pytest.raises(ValueError, match="weight"):
        read_table(spark, str(tmp_path / "n"), "parquet", S.TOPIC_NODES, S.EXPORTED_TOPIC_NODES, optional=S.OPTIONAL)


def test_unknown_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "csv", S.TOPIC_NODES)
    with pytest.raises(ValueError):
        Corpus({"nonsense": lambda: None})
    with pytest.raises(KeyError):
        Corpus({}).pivots()


def test_workspace_lies_in_the_folder_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    workspace = Workspace(spark)
    assert workspace.root.startswith(folder + "/")
    df = spark.createDataFrame([(0.5, 2), (0.3, 1)], "beta double, topic_id long")
    workspace.write("t", df, partition_by=["beta"], sort_by=["topic_id"])
    assert sorted(workspace.read("t", df.schema).collect()) == sorted(df.collect())
    assert workspace.root != Workspace(spark).root
