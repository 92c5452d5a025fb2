"""Where queries and their SQL are noted down."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

_LABEL = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN {error} WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"


def events(error: str = "1") -> str:
    """The common table expression of the event sequences."""
    return f"""ev AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
      {_LABEL.format(error=error)} AS label, value, CAST(props->>'$.k' AS INT) AS k, value * (pi() / 245) - pi() AS phase, epoch_us(ts) AS micros FROM events)"""


EV, GAP = events(), events("NULL")


def split_sql(reps: int) -> str:
    """SQL of the draws (rep, i) out of ids (i, m): the draws of a node are split over its halves by the binomial distribution, from a hash of (replicate, level, node)."""
    u = "('0x' || substr(md5(rep || ':' || level || ':' || node), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    mass = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(l / s) + (n - j) * ln(1 - l / s))"
    left = f"CASE WHEN l = s OR n = 0 THEN n ELSE len(list_filter(range(0, n), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: {mass})) <= {u})) END"
    return f"""node AS (SELECT rep::INT AS rep, 0 AS level, 0::BIGINT AS node, (2 ** ceil(log2(m)))::BIGINT AS cap, m::BIGINT AS m, m::BIGINT AS n FROM (SELECT DISTINCT m FROM ids), unnest(range(0, {reps})) AS a(rep)
   UNION ALL SELECT rep, level + 1, 2 * node + side, cap // 2, m, CASE side WHEN 0 THEN k ELSE n - k END FROM (SELECT *, {left} AS k
     FROM (SELECT *, least(cap, m - node * cap)::DOUBLE AS s, least(cap // 2, m - node * cap)::DOUBLE AS l FROM node WHERE cap > 1 AND n > 0)), unnest([0, 1]) AS h(side) WHERE (2 * node + side) * (cap // 2) < m),
 d AS (SELECT rep, node AS i FROM node, unnest(range(0, n)) AS t(x) WHERE cap = 1)"""


def query(sql: str | None = None) -> Callable:
    def note(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return note
