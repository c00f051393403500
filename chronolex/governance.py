"""Causality assertion, manifests and the append-only event log."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LeakageError(AssertionError):
    """An artifact as of a date holds data dated after it."""


def max_observed(frame: DataFrame, column: str) -> dt.date | None:
    """The latest date that an artifact really holds, measured in one pass."""
    return frame.agg(F.max(F.to_date(column))).first()[0]


def assert_causal(artifact: str, as_of: dt.date, observed: dt.date | None) -> None:
    """Equal dates and an unknown observed date pass."""
    if observed is not None and observed > as_of:
        raise LeakageError(f"{artifact}: as of {as_of}, but it holds data of {observed}")


def checksum(frame: DataFrame) -> tuple[int, int]:
    """Rows, and an order-free checksum of their contents; tells inputs apart without reading files on the driver."""
    row = frame.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*frame.columns))).first()
    return row[0], row[1] or 0


def canonical(obj) -> str:
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), default=str)


def sha256_obj(obj) -> str:
    return hashlib.sha256(canonical(obj).encode()).hexdigest()


def manifest(artifact: str, as_of: dt.date, frame: DataFrame, date_column: str | None, params: dict, inputs: dict[str, DataFrame]) -> dict:
    """Measured, not declared: the latest date, counts and checksums come from the data."""
    observed = max_observed(frame, date_column) if date_column else None
    assert_causal(artifact, as_of, observed)
    rows, sums = checksum(frame)
    return {
        "artifact": artifact, "as_of": str(as_of), "max_observed_date": str(observed) if observed else None, "params": params, "params_sha256": sha256_obj(params),
        "rows": rows, "checksum": sums, "inputs": {name: dict(zip(("rows", "checksum"), checksum(f), strict=True)) for name, f in inputs.items()},
    }


def out_of_band(quantity: str, value: float, band: tuple[float, float], phase: str) -> dict | None:
    """The event to log where a quantity lies outside the band that was written down before; nothing is tuned towards it."""
    if band[0] <= value <= band[1]:
        return None
    return {"phase": phase, "kind": "out_of_band", "quantity": quantity, "value": value, "band": list(band), "action": "stop and ask"}


class GateClosed(RuntimeError):
    """A stage that somebody has to sign off first."""


def require_signed_off(gates: dict[str, bool], name: str) -> None:
    if not gates.get(name, False):
        raise GateClosed(f"{name} is not signed off")


def log_event(path: str, event: dict) -> str:
    """Append one JSON line; undoing is another line. Returns the event's id."""
    row = event | {"ts": dt.datetime.now(dt.timezone.utc).isoformat(), "undone": event.get("undone", False)}
    row["event_id"] = sha256_obj(row)[:16]
    with Path(path).open("a") as out:
        out.write(canonical(row) + "\n")
    return row["event_id"]
