"""The registered queries as SQL over the base tables.

An independent statement of the same results: graphs by recursive SQL, labels and
similarities by joining single terms.  Nothing is shared with the Spark plans but
the query arguments and the parameters of the derivation.
"""

from __future__ import annotations

from strandline.plans import queries as q
from strandline.plans.derive import BETAS, SUPPLIER, WINDOW_YEARS

_LABELS = ("stable", "emerging", "decaying", "specific")

# name -> (tables it reads, body)
_STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "thresholds": ((), f"SELECT * FROM (VALUES {', '.join(f'(CAST({b} AS DOUBLE))' for b in BETAS)}) v(beta)"),
    "windows": (
        (),
        f"""SELECT p, first + p AS ys, first + p + {WINDOW_YEARS - 1} AS ye
        FROM (SELECT first, unnest(range(greatest(1, last - first + 2 - {WINDOW_YEARS}))) AS p
          FROM (SELECT min(year(l_shipdate)) AS first, max(year(l_shipdate)) AS last FROM lineitem) y) w""",
    ),
    "counts": (
        ("windows",),
        """SELECT p, ys, ye, l_suppkey AS coll, (p_size - 1) // 10 AS sub, p_name AS term,
          count(*) AS weight
        FROM lineitem JOIN part ON p_partkey = l_partkey
        JOIN windows ON year(l_shipdate) BETWEEN ys AND ye
        GROUP BY p, ys, ye, l_suppkey, (p_size - 1) // 10, p_name""",
    ),
    "nodes": (
        ("counts",),
        f"""SELECT * FROM (
          SELECT p * {SUPPLIER.stride} + coll * {SUPPLIER.width} + sub AS topic_id,
            ys || '-' || ye AS period, CAST(p AS INTEGER) AS period_idx, coll,
            CAST(weight AS DOUBLE) AS weight, term,
            row_number() OVER (PARTITION BY p, coll, sub ORDER BY weight DESC, term) AS position
          FROM counts) x
        WHERE position <= {SUPPLIER.top_terms}""",
    ),
    "topics": (
        ("nodes",),
        """SELECT topic_id, min(period_idx) AS period_idx, min(coll) AS coll, count(*) AS n,
          string_agg(term, ',' ORDER BY term) AS terms,
          string_agg(term, ',' ORDER BY position) AS in_order
        FROM nodes GROUP BY topic_id""",
    ),
    "links": (
        ("nodes", "topics"),
        """SELECT s, t, c / (x.n + y.n - c) AS sim, x.period_idx AS ps
        FROM (SELECT a.topic_id AS s, b.topic_id AS t, count(*) AS c
          FROM nodes a JOIN nodes b
            ON a.coll = b.coll AND a.term = b.term AND b.period_idx = a.period_idx + 1
          GROUP BY a.topic_id, b.topic_id) o
        JOIN topics x ON x.topic_id = s JOIN topics y ON y.topic_id = t""",
    ),
    "steps": (
        ("links", "thresholds"),
        """SELECT 'future' AS direction, beta, s AS a, t AS b, ps AS pa, ps + 1 AS pb, sim
        FROM links JOIN thresholds ON sim >= beta
        UNION ALL
        SELECT 'past', beta, t, s, ps + 1, ps, sim FROM links JOIN thresholds ON sim >= beta""",
    ),
    "paths": (
        ("steps",),
        """SELECT direction, beta, a AS ti, a AS tj, b AS tk, CAST(pa AS INTEGER) AS pj,
          CAST(pb AS INTEGER) AS pk, sim
        FROM steps
        UNION
        SELECT g.direction, g.beta, g.ti, s.a, s.b, CAST(s.pa AS INTEGER),
          CAST(s.pb AS INTEGER), s.sim
        FROM paths g JOIN steps s ON s.direction = g.direction AND s.beta = g.beta AND s.a = g.tk""",
    ),
    "reach": (("paths",), "SELECT DISTINCT direction, beta, ti, tk FROM paths"),
    "root_terms": (
        ("reach", "nodes"),
        """SELECT direction, beta, ti, tk, term FROM reach JOIN nodes ON topic_id = ti""",
    ),
    "common": (
        ("root_terms", "nodes"),
        # its own step, so that topics are never joined on the term alone
        """SELECT direction, beta, ti, tk, r.term
        FROM root_terms r JOIN nodes o ON o.topic_id = tk AND o.term = r.term""",
    ),
    "closeness": (
        ("reach", "common", "topics"),
        """SELECT direction, beta, ti,
          CAST(sum(CAST(round((1 - c / (x.n + y.n - c)) * 1e9) AS BIGINT)) AS DOUBLE) / 1e9
            / count(*) AS pivot_evolution
        FROM (SELECT direction, beta, ti, tk, count(term) AS c
          FROM reach LEFT JOIN common USING (direction, beta, ti, tk)
          GROUP BY direction, beta, ti, tk) o
        JOIN topics x ON x.topic_id = ti JOIN topics y ON y.topic_id = tk
        GROUP BY direction, beta, ti""",
    ),
    "label_terms": (
        ("nodes", "thresholds", "common"),
        """SELECT n.beta, n.topic_id AS ti, n.term, CASE
            WHEN p.term IS NOT NULL AND f.term IS NOT NULL THEN 'stable'
            WHEN f.term IS NOT NULL THEN 'emerging'
            WHEN p.term IS NOT NULL THEN 'decaying'
            ELSE 'specific' END AS kind
        FROM (SELECT beta, topic_id, term FROM nodes CROSS JOIN thresholds) n
        LEFT JOIN (SELECT DISTINCT beta, ti, term FROM common WHERE direction = 'past') p
          ON p.beta = n.beta AND p.ti = n.topic_id AND p.term = n.term
        LEFT JOIN (SELECT DISTINCT beta, ti, term FROM common WHERE direction = 'future') f
          ON f.beta = n.beta AND f.ti = n.topic_id AND f.term = n.term""",
    ),
    "topic_labels": (
        ("label_terms",),
        "SELECT beta, ti, "
        + ", ".join(
            f"coalesce(string_agg(term, ',' ORDER BY term) FILTER (WHERE kind = '{k}'), '') AS {k}"
            for k in _LABELS
        )
        + " FROM label_terms GROUP BY beta, ti",
    ),
    "pivots": (
        ("paths", "closeness", "topic_labels", "windows"),
        """SELECT g.direction, g.beta, g.ti AS topic_id,
          CAST((SELECT min(ys) FROM windows) + lo AS INTEGER) AS start_year,
          CAST((SELECT min(ye) FROM windows) + hi AS INTEGER) AS end_year,
          CAST(hi - lo AS INTEGER) AS liveliness, n_edges / n_tj AS split_degree,
          n_edges / n_tk AS convergence_degree, relative_evolution, pivot_evolution,
          stable, emerging, decaying, specific
        FROM (SELECT direction, beta, ti, min(least(pj, pk)) AS lo, max(greatest(pj, pk)) AS hi,
            count(*) AS n_edges, count(DISTINCT tj) AS n_tj, count(DISTINCT tk) AS n_tk,
            CAST(sum(CAST(round((1 - sim) * 1e9) AS BIGINT)) AS DOUBLE) / 1e9 / count(*)
              AS relative_evolution
          FROM paths GROUP BY direction, beta, ti) g
        JOIN closeness c ON c.direction = g.direction AND c.beta = g.beta AND c.ti = g.ti
        JOIN topic_labels l ON l.beta = g.beta AND l.ti = g.ti""",
    ),
    "topic_terms": (("nodes",), "SELECT topic_id, term FROM nodes"),
    "topic_periods": (("nodes",), "SELECT DISTINCT topic_id, period FROM nodes"),
    "period_dim": (
        ("nodes",),
        """SELECT period, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS period_idx
        FROM (SELECT DISTINCT period FROM nodes) d""",
    ),
    "frequent": (
        ("topic_terms",),
        """SELECT term, freq, CAST(rk AS INTEGER) AS rank FROM (
          SELECT term, count(*) AS freq, rank() OVER (ORDER BY count(*) DESC, term) AS rk
          FROM topic_terms GROUP BY term) x
        WHERE rk <= 50""",
    ),
    "per_period": (
        ("frequent", "topic_terms", "topic_periods"),
        """SELECT period, rank, f.term, count(*) AS freq
        FROM frequent f JOIN topic_terms t ON t.term = f.term
        JOIN topic_periods p ON p.topic_id = t.topic_id
        GROUP BY period, rank, f.term""",
    ),
    "roots": (("pivots",), "SELECT DISTINCT beta, topic_id FROM pivots"),
    "graph_rows": (
        ("paths", "roots"),
        """SELECT p.beta, ti AS root, direction, tj, tk, pj, pk, sim,
          CASE WHEN direction = 'future' THEN tj ELSE tk END AS source,
          CASE WHEN direction = 'future' THEN tk ELSE tj END AS target
        FROM paths p JOIN roots r ON r.beta = p.beta AND r.topic_id = p.ti""",
    ),
    "selected": (("pivots",), f"SELECT DISTINCT beta, topic_id FROM pivots WHERE list_contains(string_split(emerging, ','), '{q.TERM}')"),
    "selected_rows": (
        ("graph_rows", "selected"),
        "SELECT g.* FROM graph_rows g JOIN selected s ON s.beta = g.beta AND s.topic_id = g.root",
    ),
    "every_root": (("topics", "thresholds"), "SELECT beta, topic_id FROM topics CROSS JOIN thresholds"),
}


def _with(body: str, *reads: str) -> str:
    """Put the steps a query reads, and theirs, in front of it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _STEPS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in reads:
        visit(name)
    steps = ",\n".join(f"{name} AS {'MATERIALIZED ' if name == 'root_terms' else ''}({_STEPS[name][1]})" for name in ordered)
    return f"WITH RECURSIVE {steps}\n{body}"


_METRIC_COLUMNS = ("split_degree", "convergence_degree", "relative_evolution", "pivot_evolution")
_PIVOT_COLUMNS = (
    "direction, beta, topic_id, start_year, end_year, liveliness, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _METRIC_COLUMNS)
    + ", "
    + ", ".join(_LABELS)
)
_PATH_COLUMNS = "direction, beta, ti, tj, tk, pj, pk, round(sim, 6) AS sim"


def _pivots(condition: str = "TRUE") -> str:
    return _with(f"SELECT {_PIVOT_COLUMNS} FROM pivots WHERE {condition}", "pivots")


def _paths(condition: str = "TRUE", *reads: str) -> str:
    return _with(f"SELECT {_PATH_COLUMNS} FROM paths WHERE {condition}", "paths", *reads)


def _has(kind: str, term: str) -> str:
    return f"list_contains(string_split({kind}, ','), '{term}')"


def _has_any(kinds: tuple[str, ...], terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(_has(kind, term) for kind in kinds for term in terms) + ")"


def _path(self_where: str, other_where: str) -> str:
    return _pivots(
        f"""{self_where} AND EXISTS (
          SELECT 1 FROM (SELECT direction AS d2, beta AS b2, topic_id AS t2 FROM pivots
            WHERE {other_where}) o
          JOIN paths x ON x.direction = o.d2 AND x.beta = o.b2 AND x.tk = o.t2
          WHERE o.d2 = pivots.direction AND o.b2 = pivots.beta AND x.ti = pivots.topic_id
            AND ((o.d2 = 'future' AND x.ti < x.tk) OR (o.d2 = 'past' AND x.tk < x.ti)))"""
    )


def _describe_body(*columns: str, where: str = "TRUE") -> str:
    return " UNION ALL ".join(
        f"""SELECT direction, '{c}' AS metric, count({c}) AS count,
          round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev,
          round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max
        FROM pivots WHERE {where} GROUP BY direction"""
        for c in columns
    )


def _describe(*columns: str) -> str:
    return _with(_describe_body(*columns), "pivots")


def _first_per_side(columns: str, order: str) -> str:
    return _with(
        f"""SELECT {columns} FROM (SELECT *, row_number() OVER (
          PARTITION BY direction ORDER BY {order}) AS rn FROM pivots) x
        WHERE rn <= {q.TOP_ROWS}""",
        "pivots",
    )


def _graph(columns: str, reads: tuple[str, ...] = ()) -> str:
    return _with(f"SELECT DISTINCT {columns} FROM graph_rows", "graph_rows", *reads)


def _selected_graph(columns: str) -> str:
    return _with(f"SELECT DISTINCT {columns} FROM selected_rows", "selected_rows")


def _in_order(column: str, order: str) -> str:
    return _with(
        f"""SELECT direction, place, beta, topic_id, round({column}, 6) AS {column} FROM (
          SELECT *, row_number() OVER (
            PARTITION BY direction ORDER BY pivots.{column} {order}, beta, topic_id) AS place
          FROM pivots) x
        WHERE place <= {q.TOP_ROWS}""",
        "pivots",
    )


def _node_rows(key: str, rows: str = "graph_rows") -> str:
    return _with(
        f"""SELECT n.*, {', '.join(_LABELS)} FROM (
          SELECT {key}, tj AS topic_id FROM {rows}
          UNION SELECT {key}, tk FROM {rows}) n
        JOIN topic_labels l ON l.beta = n.beta AND l.ti = n.topic_id""",
        rows,
        "topic_labels",
    )


def _timeline_rows(key: str, rows: str = "graph_rows") -> str:
    return _with(
        f"""SELECT n.*, d.period FROM (
          SELECT {key}, pj AS period_idx FROM {rows}
          UNION SELECT {key}, pk FROM {rows}) n
        JOIN period_dim d ON d.period_idx = n.period_idx""",
        rows,
        "period_dim",
    )


_SELECTED_TOPICS = f"""SELECT DISTINCT direction, topic_id FROM pivots
  WHERE {_has('emerging', q.TERM)}"""
_IDS = ", ".join(str(i) for i in q.TOPIC_IDS)
_PERIODS = ", ".join(f"'{p}'" for p in q.PERIODS)
_T = q.TERM
_O = q.OTHER_TERM
_SIM = "round(sim, 6) AS sim"

#: Queries that give the rows of another one by other means.
_SAME = {
    "co_sel_edges": "g_sel_edges",
    "co_sel_multi_edges": "g_sel_multi_edges",
    "co_sel_nodes": "g_sel_nodes",
    "co_sel_timeline_nodes": "g_sel_timeline_nodes",
    "co_sel_shape": "g_sel_shape",
    "co_single_edges": "g_single_edges",
    "inc_term_freq": "term_freq",
    "inc_label_per_period": "label_per_period",
    "inc_period_terms": "period_terms",
    "sum_describe": "rep_describe",
    "sum_describe_cols": "rep_describe_cols",
    "sum_bounds": "facet_bounds",
}


def oracle_sql() -> dict[str, str]:
    contains = _has_any(_LABELS, (_T,))
    found = {
        "pivots_load": _pivots(),
        "paths_scan": _paths("beta = 0.5"),
        "src_json": _pivots(),
        "src_json_paths": _paths(),
        "src_json_labels": _with(
            f"SELECT beta, ti, {', '.join(_LABELS)} FROM topic_labels", "topic_labels"
        ),
        "src_parquet": _pivots(),
        **{
            f"src_{fmt}_{table}": _with(body, *reads)
            for fmt in ("json", "parquet")
            for table, body, *reads in (
                ("topic_nodes", "SELECT topic_id, period, weight, term FROM nodes", "nodes"),
                ("topic_dictionary", "SELECT topic_id, terms FROM topics", "topics"),
                (
                    "vocabulary",
                    "SELECT min(topic_id * 100 + position) AS id, term FROM nodes GROUP BY term",
                    "nodes",
                ),
                ("similarity_links", f"SELECT s, t, {_SIM} FROM links", "links"),
                (
                    "individuals",
                    """SELECT e.beta, e.topic_id, terms, t.period_idx
                    FROM every_root e JOIN topics t ON t.topic_id = e.topic_id
                    WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.beta = e.beta AND p.ti = e.topic_id)""",
                    "every_root",
                    "topics",
                    "paths",
                ),
            )
        },
        "links_top": _with(
            f"SELECT s, t, {_SIM} FROM (SELECT * FROM links ORDER BY links.sim DESC, s, t"
            f" LIMIT {q.TOP_ROWS}) x",
            "links",
        ),
        "node_lookup": _with(
            f"SELECT topic_id, period, weight, term FROM nodes WHERE topic_id = {q.NODE_ID}",
            "nodes",
        ),
        "vocab_lookup": _with(
            f"""SELECT id, term FROM (SELECT min(topic_id * 100 + position) AS id, term
            FROM nodes GROUP BY term) v WHERE id = {q.VOCABULARY_ID}""",
            "nodes",
        ),
        "topic_lookup": _with(
            f"SELECT topic_id, terms FROM topics WHERE topic_id = {q.NODE_ID}", "topics"
        ),
        "topic_lookup_ordered": _with(
            f"SELECT topic_id, in_order AS terms FROM topics WHERE topic_id = {q.NODE_ID}", "topics"
        ),
        "nodes_top": _with(
            f"""SELECT topic_id, period, weight, term FROM nodes
            ORDER BY topic_id, weight DESC, term LIMIT {q.TOP_ROWS}""",
            "nodes",
        ),
        "labels_any_emerging": _with(
            "SELECT beta, ti AS topic_id FROM topic_labels WHERE "
            + _has_any(("emerging",), q.SEARCH_TERMS),
            "topic_labels",
        ),
        "ix_any_emerging": _with(
            "SELECT beta, ti AS topic_id FROM topic_labels WHERE "
            + _has_any(("emerging",), q.SEARCH_TERMS),
            "topic_labels",
        ),
        "ix_emerge": _pivots(_has("emerging", _T)),
        "ix_contains": _pivots(contains),
        "ix_all": _pivots(f"{_has('emerging', _T)} AND {_has('stable', q.OTHER_TERM)}"),
        "ix_counts": _with(
            " UNION ALL ".join(
                f"SELECT term, '{kind}' AS kind, count(*) AS postings FROM (SELECT DISTINCT direction, beta,"
                f" topic_id, unnest(string_split({kind}, ',')) AS term FROM pivots) WHERE term <> '' GROUP BY term"
                for kind in _LABELS
            ),
            "pivots",
        ),
        "f_emerge": _pivots(_has("emerging", _T)),
        "f_decay": _pivots(_has("decaying", _T)),
        "f_stable": _pivots(_has("stable", _T)),
        "f_specific": _pivots(_has("specific", _T)),
        "f_contains": _pivots(contains),
        "f_period_from": _pivots("start_year >= 1996"),
        "f_period_to": _pivots("end_year <= 2000"),
        "f_live": _pivots("liveliness >= 3"),
        "f_live_to": _pivots("liveliness <= 2"),
        "f_split": _pivots("pivots.split_degree >= 1.2"),
        "f_split_to": _pivots("pivots.split_degree <= 1.5"),
        "f_conv": _pivots("pivots.convergence_degree >= 1.1"),
        "f_conv_to": _pivots("pivots.convergence_degree <= 1.1"),
        "f_revol": _pivots("pivots.relative_evolution >= 0.5"),
        "f_revol_to": _pivots("pivots.relative_evolution <= 0.4"),
        "f_pevol": _pivots("pivots.pivot_evolution >= 0.6"),
        "f_pevol_to": _pivots("pivots.pivot_evolution <= 0.5"),
        "search_all": _pivots(
            f"""{contains} AND {_has('emerging', _O)} AND start_year >= 1995
            AND end_year <= 2000 AND direction = 'future' AND liveliness BETWEEN 1 AND 3
            AND pivots.split_degree BETWEEN 1.0 AND 3.0
            AND pivots.convergence_degree BETWEEN 1.0 AND 2.0
            AND pivots.relative_evolution BETWEEN 0.1 AND 0.7
            AND pivots.pivot_evolution BETWEEN 0.1 AND 0.8"""
        ),
        "search_kinds": _pivots(
            f"""{_has('stable', _T)} AND {_has('decaying', _O)} AND start_year >= 1995
            AND end_year <= 2001 AND liveliness BETWEEN 1 AND 9"""
        ),
        "search_specific": _pivots(f"{_has('specific', _T)} AND direction = 'past'"),
        "proj_future": _pivots("direction = 'future'"),
        "proj_past": _pivots("direction = 'past'"),
        "set_union": _with(
            f"""SELECT {_PIVOT_COLUMNS} FROM (SELECT * FROM pivots WHERE {contains}
            UNION ALL SELECT * FROM pivots WHERE direction = 'future'
              AND {_has('emerging', _T)}) u""",
            "pivots",
        ),
        "set_intersect": _with(
            f"""SELECT {_PIVOT_COLUMNS} FROM (SELECT * FROM pivots WHERE {contains}
            INTERSECT SELECT * FROM pivots WHERE {_has_any(_LABELS, (_O,))}) u""",
            "pivots",
        ),
        "set_minus": _with(
            f"""SELECT {_PIVOT_COLUMNS} FROM (
              (SELECT * FROM pivots WHERE {contains} AND direction = 'future'
              EXCEPT SELECT * FROM pivots WHERE direction = 'future' AND {_has('emerging', _T)})
              UNION ALL SELECT * FROM pivots WHERE {contains} AND direction = 'past') u""",
            "pivots",
        ),
        "set_intersect_missing": _with(
            f"""SELECT DISTINCT {_PIVOT_COLUMNS} FROM pivots WHERE {contains} AND direction = 'past'""",
            "pivots",
        ),
        "set_union_missing": _pivots(
            f"(direction = 'past' AND {contains}) OR (direction = 'future' AND {_has('emerging', _T)})"
        ),
        "path_future": _path("direction = 'future'", f"direction = 'future' AND {_has('emerging', _O)}"),
        "path_past": _path("direction = 'past'", f"direction = 'past' AND {_has('decaying', _O)}"),
        "path_both": _path(contains, "liveliness >= 2"),
        "sort_asc": _pivots(),
        "sort_desc": _pivots(),
        "sort_asc_order": _in_order("pivot_evolution", "ASC"),
        "sort_desc_order": _in_order("liveliness", "DESC"),
        "rep_show": _first_per_side(_PIVOT_COLUMNS, "beta, topic_id"),
        "rep_labels": _first_per_side(
            f"direction, beta, topic_id, {', '.join(_LABELS)}", "beta, topic_id"
        ),
        "rep_topics": _with(
            f"""SELECT direction, s.topic_id, terms FROM ({_SELECTED_TOPICS}) s
            JOIN topics t ON t.topic_id = s.topic_id""",
            "pivots",
            "topics",
        ),
        "rep_topics_ordered": _with(
            f"""SELECT direction, s.topic_id, in_order AS terms FROM ({_SELECTED_TOPICS}) s
            JOIN topics t ON t.topic_id = s.topic_id""",
            "pivots",
            "topics",
        ),
        "rep_describe_empty": _with(
            _describe_body("liveliness", *_METRIC_COLUMNS, where="direction = 'past'")
            + " UNION ALL SELECT 'future', metric, 0, NULL, NULL, NULL, NULL FROM (VALUES "
            + ", ".join(f"('{c}')" for c in ("liveliness", *_METRIC_COLUMNS))
            + ") m(metric)",
            "pivots",
        ),
        "rep_terms": _with(
            f"""SELECT direction, term, count(*) AS n_topics FROM ({_SELECTED_TOPICS}) s
            JOIN topic_terms t ON t.topic_id = s.topic_id GROUP BY direction, term""",
            "pivots",
            "topic_terms",
        ),
        "rep_describe": _describe("liveliness", *_METRIC_COLUMNS),
        "rep_describe_cols": _describe("start_year", "end_year", "split_degree"),
        "topic_period": _with("SELECT topic_id, period FROM topic_periods", "topic_periods"),
        "period_list": _with("SELECT period, period_idx FROM period_dim", "period_dim"),
        "term_freq": _with("SELECT term, freq, rank FROM frequent", "frequent"),
        "label_per_period": _with("SELECT period, rank, term, freq FROM per_period", "per_period"),
        "period_terms": _with(
            f"""SELECT rank, term, freq FROM per_period
            WHERE period = '{q.START_YEAR}-{q.START_YEAR + 2}' ORDER BY rank LIMIT {q.TOP_ROWS}""",
            "per_period",
        ),
        "period_compare": _with(
            f"""SELECT * FROM (SELECT period, CAST(row_number() OVER (
              PARTITION BY period ORDER BY rank) AS INTEGER) AS place, rank, term, freq
            FROM per_period WHERE period IN ({_PERIODS})) x WHERE place <= {q.TOP_TERMS}""",
            "per_period",
        ),
        "sql_period_terms": _with(
            f"""SELECT period, rank, term, freq FROM per_period
            WHERE period = '{q.START_YEAR}-{q.START_YEAR + 2}'""",
            "per_period",
        ),
        "sql_labels_of_threshold": _with(
            f"SELECT ti, {', '.join(_LABELS)} FROM topic_labels WHERE beta = {q.SEARCH_BETA}", "topic_labels"
        ),
        "facet_terms": _with(
            "SELECT DISTINCT kind, term FROM label_terms l JOIN roots r"
            " ON r.beta = l.beta AND r.topic_id = l.ti",
            "label_terms",
            "roots",
        ),
        "facet_keywords": _with(
            "SELECT DISTINCT term FROM label_terms l JOIN roots r"
            " ON r.beta = l.beta AND r.topic_id = l.ti",
            "label_terms",
            "roots",
        ),
        "facet_bounds": _with(
            """SELECT (SELECT max(n) - 1 FROM (SELECT count(DISTINCT start_year) AS n
              FROM pivots GROUP BY direction) y) AS max_liveliness,
              round(max(split_degree), 6) AS max_split_degree,
              round(max(convergence_degree), 6) AS max_convergence_degree,
              min(start_year) AS first_year, max(end_year) AS last_year
            FROM pivots""",
            "pivots",
        ),
        "g_roots": _with("SELECT beta, topic_id FROM roots", "roots"),
        "g_topics_by_beta": _with(
            """SELECT beta, topic_id // 1000 AS id_block,
              string_agg(CAST(topic_id AS VARCHAR), ',' ORDER BY topic_id) AS topic_ids
            FROM roots GROUP BY beta, topic_id // 1000""",
            "roots",
        ),
        "g_single_edges": _graph(f"beta, root, direction, source, target, {_SIM}"),
        "g_multi_edges": _graph(f"beta, direction, source, target, {_SIM}"),
        "g_multi_topics": _paths(f"ti IN ({_IDS})"),
        "g_label_search": _paths(
            f"""beta = {q.SEARCH_BETA} AND ti IN (SELECT ti FROM topic_labels
            WHERE beta = {q.SEARCH_BETA} AND {_has_any(('emerging',), q.SEARCH_TERMS)})""",
            "topic_labels",
        ),
        "g_label_search_all": _paths(
            f"""EXISTS (SELECT 1 FROM topic_labels l WHERE l.beta = paths.beta AND l.ti = paths.ti
            AND {_has_any(('emerging',), q.SEARCH_TERMS)})""",
            "topic_labels",
        ),
        "g_sel_edges": _selected_graph(f"beta, root, direction, source, target, {_SIM}"),
        "g_sel_multi_edges": _selected_graph(f"beta, direction, source, target, {_SIM}"),
        "g_sel_nodes": _node_rows("beta, root", "selected_rows"),
        "g_sel_timeline_nodes": _timeline_rows("beta, root", "selected_rows"),
        "g_sel_shape": _with(
            """SELECT e.beta, e.topic_id AS root, count(*) FILTER (direction = 'future') AS n_future,
              count(*) FILTER (direction = 'past') AS n_past,
              CASE WHEN count(DISTINCT direction) = 2 THEN 'both'
                ELSE coalesce(min(direction), 'none') END AS shape
            FROM selected e LEFT JOIN paths p ON p.beta = e.beta AND p.ti = e.topic_id
            GROUP BY e.beta, e.topic_id""",
            "selected",
            "paths",
        ),
        "g_bidir": _graph(f"beta, root, source, target, {_SIM}"),
        "g_multi_bidir": _graph(f"beta, source, target, {_SIM}"),
        "g_edge_style": _graph(
            f"""beta, root, source, target, {_SIM},
            round(round_even(sim * 100, 0) / 100, 6) AS sim_rounded,
            round((round_even(sim * 100, 0) / 100 - beta) * 9.0 / (1.0 - beta) + 1.0, 6)
              AS strength"""
        ),
        "g_nodes": _node_rows("beta, root"),
        "g_multi_nodes": _node_rows("beta"),
        "g_timeline_nodes": _timeline_rows("beta, root"),
        "g_multi_timeline_nodes": _timeline_rows("beta"),
        "g_timeline_edges": _graph("beta, root, least(pj, pk) AS from_idx, greatest(pj, pk) AS to_idx"),
        "g_multi_timeline_edges": _graph("beta, least(pj, pk) AS from_idx, greatest(pj, pk) AS to_idx"),
        "g_graph_shape": _with(
            """SELECT e.beta, e.topic_id AS root, count(*) FILTER (direction = 'future') AS n_future,
              count(*) FILTER (direction = 'past') AS n_past,
              CASE WHEN count(DISTINCT direction) = 2 THEN 'both'
                ELSE coalesce(min(direction), 'none') END AS shape
            FROM every_root e LEFT JOIN paths p ON p.beta = e.beta AND p.ti = e.topic_id
            GROUP BY e.beta, e.topic_id""",
            "every_root",
            "paths",
        ),
        "g_isolated": _with(
            """SELECT e.beta, e.topic_id, terms, d.period_idx, d.period
            FROM every_root e JOIN topics t ON t.topic_id = e.topic_id
            JOIN period_dim d ON d.period_idx = t.period_idx
            WHERE NOT EXISTS (SELECT 1 FROM paths p WHERE p.beta = e.beta AND p.ti = e.topic_id)""",
            "every_root",
            "topics",
            "paths",
            "period_dim",
        ),
    }
    return found | {name: found[twin] for name, twin in _SAME.items()}
