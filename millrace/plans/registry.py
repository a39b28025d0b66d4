"""The registry: a query is a function of session and table folder; ``sql`` is DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

#: Common table expressions over the driver's tables, as ``sources.derive`` has them.
EVENTS = """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS et, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
CALLS = EVENTS + """, c AS (SELECT event_id AS call_id, user_id AS calling, (user_id + 1 + k % 7) % 150 AS called, et // 600 AS answer_ts, CAST(floor(value * 60) AS BIGINT) AS duration, event_type <> 'error' AS established FROM ev)"""
REPORTS = EVENTS + """, r0 AS (SELECT event_id, (et - 1704067200) // 240 AS time, user_id AS vid, CAST(floor(value) AS BIGINT) % 101 AS speed, user_id % 2 AS xway, k % 5 AS lane, event_id % 2 AS direction, k // 10 AS segment FROM ev), r AS (SELECT *, time // 60 + 1 AS minute FROM r0)"""
ADS = EVENTS + """, dim AS (SELECT DISTINCT user_id AS ad_id, user_id % 10 AS campaign_id FROM events WHERE user_id % 17 <> 0), v AS (SELECT ev.*, campaign_id FROM ev JOIN dim ON ad_id = user_id WHERE event_type = 'view')"""
LINES = """l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), l AS (SELECT doc_id, doc_id * 1000000000 + line_no AS pos, line FROM l0)"""
WORDS = LINES + """, w AS (SELECT doc_id, pos, unnest(string_split(rtrim(line, ' '), ' ')) AS word, generate_subscripts(string_split(rtrim(line, ' '), ' '), 1) - 1 AS word_no FROM l WHERE line = '' OR rtrim(line, ' ') <> '')"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        _queries[key] = f
        if sql:
            _sql[key] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
