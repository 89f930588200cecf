"""What the service asks of a projection and of its reads, and what any storage offers."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class ProjectionStore(Protocol):
    """Applies the log to the derived tables. Applying the same entries again changes nothing."""

    def initialize(self) -> None: ...

    def project(self, deadline_s: float | None = None) -> int:
        """Applies all entries that aren't, and returns their number. ``Terminal`` means that trying again can't help."""

    def applied(self) -> DataFrame | None:
        """The ids that are applied, in a column request_id; None before the first."""

    def health(self) -> dict: ...

    def close(self) -> None: ...


@runtime_checkable
class ReadStore(Protocol):
    """The fixed reads. Limits are hard caps, which the service sets."""

    def dashboard(self, filters: dict | None = None) -> dict: ...

    def events(self, limit: int) -> dict: ...

    def users(self, limit: int) -> dict: ...


class Terminal(Exception):
    """A failure that trying again can't mend."""


class SnapshotStore:
    """The projection of a log folder into the snapshots of a table folder."""

    def __init__(self, snapshots, log_folder: str, checkpoint: str):
        self.snapshots, self.log_folder, self.checkpoint, self.closed = snapshots, log_folder, checkpoint, False

    def initialize(self) -> None:
        self.snapshots.manifest()

    def project(self, deadline_s: float | None = None) -> int:
        if self.closed:
            raise Terminal("the store is closed")
        return self.snapshots.project(self.log_folder, self.checkpoint, deadline_s)

    def applied(self) -> DataFrame | None:
        return self.snapshots.read("applied")

    def health(self) -> dict:
        m = self.snapshots.manifest()
        return {"batch": m["batch"], "entries": m["next_offset"]}

    def bulk_import(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        return self.snapshots.bulk_import(tables)

    def close(self) -> None:
        self.closed = True
