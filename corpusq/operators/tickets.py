"""One-time tickets with a time to live: tickets(ticket_id, user_id, tenant_id, role, expires_at)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS = 60


def expiry(at: Column, seconds: int = SECONDS) -> Column:
    return at + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def issue(tickets: DataFrame, user_id: str, tenant_id: str, role: str, now: Column | None = None) -> tuple[DataFrame, str]:
    """The table with a new ticket, and the ticket's id."""
    key = str(uuid.uuid4())
    row = tickets.sparkSession.createDataFrame([(key, user_id, tenant_id, role)], "ticket_id string, user_id string, tenant_id string, role string")
    row = row.withColumn("expires_at", expiry(F.current_timestamp() if now is None else now))
    return tickets.unionByName(row.select(*[F.col(f.name).cast(f.dataType) for f in tickets.schema])), key


def live(tickets: DataFrame, now: Column | None = None) -> DataFrame:
    """Without those that have expired."""
    return tickets.where(F.col("expires_at") > (F.current_timestamp() if now is None else now))


def consume(tickets: DataFrame, ticket_id: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(user_id, tenant_id, role) of the ticket if it is known and alive, and the table without it.

    A ticket that has expired gives no row and stays until it is cleaned up with ``live``.
    """
    hit = live(tickets, now).where(F.col("ticket_id") == ticket_id)
    return hit.select("user_id", "tenant_id", "role"), tickets.join(hit.select("ticket_id"), "ticket_id", "left_anti").select(*tickets.columns)
