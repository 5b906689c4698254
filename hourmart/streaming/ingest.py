"""Incremental ingest: validate, repair, audit and upsert each micro-batch."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame

from hourmart.operators.quality import RULES, RangeRule, change_audit, repair, touch, validate
from hourmart.operators.writes import latest_per_key
from hourmart.session import written
from hourmart.sources.tables import Warehouse


@dataclass(frozen=True)
class IngestJob:
    """Target, audit and reject tables of an ingest, and how rows are told apart."""

    warehouse: Warehouse
    table: str
    keys: list[str]
    update: list[str]
    partition: str
    order: list[str]
    temp: str = "temperature_c"
    rain: str = "rain_mm"
    rules: tuple[RangeRule, ...] = RULES

    @property
    def audit(self) -> str:
        return f"{self.table}_history"

    @property
    def rejects(self) -> str:
        return f"{self.table}_rejects"


def ingest_batch(job: IngestJob, batch: DataFrame, batch_id: int, as_of: Column, source: str = "") -> None:
    """One micro-batch through the batch operators; safe to run again.

    Rejects and audit rows are written once per source and batch id, before the
    target changes; a source is one stream with its checkpoint, whose ids start at 0; the upsert itself gives the same table however often it runs.
    """
    accepted, rejected = validate(batch, job.rules)
    clean = latest_per_key(repair(accepted, job.rain), job.keys, job.order)
    rows = written(touch(clean, as_of), "incoming")
    name = f"batch {source} {batch_id}"
    job.warehouse.write_once(job.rejects, rejected, name)
    old = job.warehouse.touched(job.table, rows, job.partition)
    changes = change_audit(old, rows, job.keys, as_of, job.temp, job.rain)
    job.warehouse.write_once(job.audit, changes, name)
    job.warehouse.upsert(
        job.table, rows, job.keys, [*job.update, "updated_at"], job.partition)


def run_ingest(job: IngestJob, stream: DataFrame, as_of: Column, checkpoint: str) -> None:
    """Process all available input of ``stream`` into the target table."""
    source = sha256(checkpoint.encode()).hexdigest()[:16]
    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: ingest_batch(job, batch, batch_id, as_of, source))
        .start()
    )
    query.awaitTermination()
