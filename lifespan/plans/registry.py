"""Named queries over the given tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# -- SQL fragments shared by the twins ------------------------------------------
READINGS = """
ev AS (SELECT user_id AS unit_id, event_id AS row_number,
              epoch_us(ts) / 1e6 - 1704067200 AS t, event_type AS channel, value FROM events)"""
STEPS = """
st0 AS (SELECT user_id AS unit_id, event_id AS row_number, epoch_us(ts) / 1e6 - 1704067200 AS t, value,
               CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) AS k,
               CAST(hour(ts) AS DOUBLE) AS hour FROM events),
st AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY t, row_number) - 1 AS step,
              count(*) OVER (PARTITION BY unit_id) AS n_steps FROM st0)"""
SUPPLIER_DAYS = """
sd AS (SELECT l_suppkey AS unit_id, CAST(l_shipdate AS DATE) AS day,
              CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
              max(l_discount) AS discount, max(l_tax) AS tax, count(*) AS n_lines,
              CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t
       FROM lineitem GROUP BY 1, 2, 8)"""
# windows of 16 event steps every 4 steps, one row per window, step and channel
WINDOW_CELLS = STEPS + """,
win AS (SELECT unit_id, (step - 15) // 4 AS window_index, step AS end_step, t AS t_end, n_steps
        FROM st WHERE step >= 15 AND (step - 15) % 4 = 0),
cells AS (SELECT w.unit_id, w.window_index, w.t_end, w.end_step, w.n_steps, s.step - w.end_step + 15 AS i,
                 unnest([0, 1, 2]) AS c, unnest([s.value, s.k, s.hour]) AS v
          FROM win w JOIN st s ON s.unit_id = w.unit_id AND s.step BETWEEN w.end_step - 15 AND w.end_step)"""
EMBEDDING_CELLS = """
ec0 AS (SELECT vec_id AS unit_id, label, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings),
cells AS (SELECT unit_id, 0 AS window_index, CAST(unit_id AS DOUBLE) AS t_end, label,
                 p // 4 AS i, p % 4 AS c, CAST(e AS DOUBLE) AS v FROM ec0)"""


def stats_sql(keys: str, edge: int, length: int = 16) -> str:
    """One row per window and channel with the thirteen statistics (needs ``cells``)."""
    return f"""
stats AS (SELECT {keys}, c,
    max(v) FILTER (i = {length - 1}) AS "last", max(v) FILTER (i = 0) AS "first",
    max(v) FILTER (i = {length - 1}) - max(v) FILTER (i = 0) AS delta,
    avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max,
    quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75,
    sum((-1 + 2.0 * i / {length - 1}) * v) / sum((-1 + 2.0 * i / {length - 1}) * (-1 + 2.0 * i / {length - 1})) AS slope,
    avg(v) FILTER (i >= {length - edge}) AS tail_mean, avg(v) FILTER (i < {edge}) AS head_mean
    FROM cells GROUP BY ALL)"""
