"""The shop's clients through their changes: what holds now, what held when, and sales by what held then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.asof import asof_join
from tessera.operators.changes import apply_changes, history, sayings
from tessera.tables import table

_VALUES = ("source", "segment", "city", "balance")
_ORDER = ("seq", "change_id")
_DELETED = "op = 'D'"


def client_state(spark: SparkSession, d: str) -> DataFrame:
    """Clients after all changes that are later than what the table of clients knows."""
    clients = table(spark, d, "clients")
    return apply_changes(clients, table(spark, d, "client_changes"), ["client_id"], "updated_at", "valid_at", _ORDER, _VALUES, _DELETED).select("client_id", "updated_at", "name", *_VALUES)


def client_history(spark: SparkSession, d: str) -> DataFrame:
    """Versions of each client, with the time for which each holds."""
    return history(table(spark, d, "client_changes"), ["client_id"], "valid_at", _ORDER, _VALUES, _DELETED)


def sales_by_version(spark: SparkSession, d: str) -> DataFrame:
    """J5 at a point in time: each sale with what held of its client when it was sold; null where the client was deleted or not yet known."""
    said = sayings(table(spark, d, "client_changes"), ["client_id"], "valid_at", _ORDER, _VALUES, _DELETED)
    sales = table(spark, d, "sales").select("sale_id", "client_id", "sold_at")
    found = asof_join(sales, said, ["client_id"], "sold_at", "valid_at", ["values"], strict=False)
    return found.select("sale_id", "client_id", "sold_at", "values.segment", "values.city")


QUERIES = {f.__name__: f for f in (client_state, client_history, sales_by_version)}

_BEST = """ranked AS (
    SELECT *, row_number() OVER (PARTITION BY client_id, valid_at
        ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST, coalesce(op = 'D', false) DESC, source DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST, balance DESC NULLS LAST) AS k
    FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL),
said AS (
    SELECT client_id, valid_at, coalesce(op = 'D', false) AS gone,
           CASE WHEN coalesce(op = 'D', false) THEN NULL ELSE {'source': source, 'segment': segment, 'city': city, 'balance': balance} END AS v
    FROM ranked WHERE k = 1)"""
ORACLE_SQL = {
    "client_state": f"""
        WITH {_BEST}, last AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY valid_at DESC) = 1),
        j AS (SELECT c.*, valid_at, gone, v, coalesce(valid_at > updated_at, valid_at IS NOT NULL) AS newer FROM clients c LEFT JOIN last l ON l.client_id = c.client_id)
        SELECT client_id, CASE WHEN newer THEN valid_at ELSE updated_at END AS updated_at, name, CASE WHEN newer THEN v.source ELSE source END AS source,
               CASE WHEN newer THEN v.segment ELSE segment END AS segment, CASE WHEN newer THEN v.city ELSE city END AS city, CASE WHEN newer THEN v.balance ELSE balance END AS balance
        FROM j WHERE NOT (newer AND coalesce(gone, false))
        UNION ALL
        SELECT client_id, valid_at, NULL, v.source, v.segment, v.city, v.balance
        FROM last l WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM clients c WHERE c.client_id = l.client_id)
    """,
    "client_history": f"""
        WITH {_BEST}, k AS (SELECT *, row_number() OVER w AS n, lag(v) OVER w AS p FROM said WINDOW w AS (PARTITION BY client_id ORDER BY valid_at)),
        changed AS (SELECT * FROM k WHERE v IS DISTINCT FROM p),
        u AS (SELECT *, lead(valid_at) OVER (PARTITION BY client_id ORDER BY valid_at) AS valid_to FROM changed)
        SELECT client_id, valid_at AS valid_from, valid_to, v.source, v.segment, v.city, v.balance FROM u WHERE v IS NOT NULL
    """,
    "sales_by_version": f"""
        WITH {_BEST}
        SELECT sale_id, s.client_id, sold_at, v.segment, v.city FROM sales s ASOF LEFT JOIN said ON s.client_id = said.client_id AND s.sold_at >= said.valid_at
    """,
}
