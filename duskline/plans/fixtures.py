"""Views over the driver tables with derived coordinates, intervals and panels, as DataFrames and as SQL.

The derivations are integer arithmetic that Spark and any SQL engine evaluate alike. ``SQL[name]`` is the body of a common
table expression; ``with_views("pts", "ivals")`` gives the WITH clause for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duskline.session import table

#: Bodies of the views. Where Spark and the oracle's dialect differ, {hours}, {seconds} and {epoch} are filled in.
_VIEWS = {
    "pts": "SELECT event_id, user_id, event_type, value, ts AS t, CAST((user_id * 7919 + event_id * 104729) % 5000 AS DOUBLE) AS x_m, CAST((user_id * 6151 + event_id * 15485863) % 5000 AS DOUBLE) AS y_m FROM events",
    "ivals": "SELECT o_orderkey AS id, o_custkey AS cust, {seconds:TIMESTAMP_NTZ '2024-01-01 00:00:00'|o_orderkey * 9973 % 2592000} AS start_ts, CASE WHEN o_orderkey % 17 <> 0 THEN {seconds:TIMESTAMP_NTZ '2024-01-01 00:00:00'|o_orderkey * 9973 % 2592000 + o_custkey * 31 % 400 * 900} END AS end_ts, CAST((o_custkey * 7919) % 5000 AS DOUBLE) AS x_m, CAST((o_custkey * 6151) % 5000 AS DOUBLE) AS y_m, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "regions": "SELECT s_suppkey AS rid, CAST((s_suppkey * 1237) % 5000 AS DOUBLE) AS rx, CAST((s_suppkey * 2477) % 5000 AS DOUBLE) AS ry, CAST(1 + s_suppkey % 5 AS DOUBLE) AS sigma, s_nationkey % 5 AS city FROM supplier",
    "jobs": "SELECT o_orderkey AS id, {seconds:CAST(o_orderdate AS TIMESTAMP_NTZ)|o_orderkey * 7919 % 86400} AS arrival, o_totalprice AS score, o_custkey % 5 AS region FROM orders",
    "dirty": "SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP_NTZ) AS start_ts, max(CAST(l_shipdate AS TIMESTAMP_NTZ)) AS end_ts, o_orderstatus AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_orderstatus",
    "panel": "SELECT u AS unit, CAST(floor(u / 2) AS BIGINT) AS pair, u % 2 AS treatment, u % 50 AS cluster, p AS period, CAST(count(e.event_id) AS DOUBLE) AS y FROM (SELECT DISTINCT user_id AS u FROM events) CROSS JOIN (SELECT DISTINCT CAST(least(floor((day(ts) - 1) / 10), 2) AS INT) AS p FROM events) LEFT JOIN events e ON e.user_id = u AND CAST(least(floor((day(e.ts) - 1) / 10), 2) AS INT) = p GROUP BY u, p",
    "weeks": "SELECT u AS unit, u % 2 AS treatment, u % 50 AS cluster, w AS week, CAST(count(e.event_id) AS DOUBLE) AS y FROM (SELECT DISTINCT user_id AS u FROM events) CROSS JOIN (SELECT DISTINCT CAST(floor((day(ts) - 1) * 9 / 31) AS INT) - 4 AS w FROM events) LEFT JOIN events e ON e.user_id = u AND CAST(floor((day(e.ts) - 1) * 9 / 31) AS INT) - 4 = w GROUP BY u, w",
    "preds": "SELECT d.doc_id, CAST(quality AS INT) AS y, (n_chars % 1000) / 1000.0D AS p, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
}


def _filled(text: str, spark: bool) -> str:
    out = []
    while (at := text.find("{seconds:")) >= 0:
        end = text.index("}", at)
        base, seconds = text[at + 9 : end].split("|")
        out += [text[:at], f"{base} + make_dt_interval(0, 0, 0, {seconds})" if spark else f"{base} + to_seconds({seconds})"]
        text = text[end + 1 :]
    text = "".join(out) + text
    return text if spark else text.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("1000.0D", "1000.0::DOUBLE")


SQL = {name: _filled(body, spark=False) for name, body in _VIEWS.items()}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables of ``sf_dir``."""
    tables = {t: table(spark, sf_dir, t) for t in ("events", "orders", "customer", "nation", "region", "supplier", "lineitem", "documents", "labels") if f" {t} " in f" {_VIEWS[name]} ".replace(")", " ")}
    text = _filled(_VIEWS[name], spark=True)
    for t in tables:
        text = _named(text, t)
    return spark.sql(text, **tables)


def _named(text: str, t: str) -> str:
    """``FROM t`` and ``JOIN t`` as references to the DataFrame argument, aliased to the table's name."""
    import re

    return re.sub(rf"\b(FROM|JOIN) {t}\b(?! [a-z]\b)", rf"\1 {{{t}}} AS {t}", re.sub(rf"\b(FROM|JOIN) {t} ([a-z])\b", rf"\1 {{{t}}} AS \2", text))
