"""One scheduled update at a time, on the driver: idle, waiting, running, then completed, failed or cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

ACTIVE = ("waiting", "running")


@dataclass(frozen=True)
class State:
    status: str = "idle"
    job_id: str | None = None
    scheduled_for: datetime | None = None
    created_at: datetime | None = None
    started_at: datetime | None = None
    finished_at: datetime | None = None
    caps: dict[str, int] = field(default_factory=dict)
    result: Any = None
    error: str | None = None


class Schedule:
    def __init__(self, update: Callable[..., Any]):
        self.update, self.state = update, State()
        self._guard, self._cancel, self._thread = threading.Lock(), threading.Event(), None

    def _move(self, job_id: str, when: tuple[str, ...], **changes: Any) -> bool:
        """Changes the state if this job is still in one of the given states."""
        with self._guard:
            fits = self.state.job_id == job_id and self.state.status in when
            if fits:
                self.state = replace(self.state, **changes)
            return fits

    def at(self, when: datetime, **caps: int) -> State:
        """Schedules the update; times without a zone are UTC."""
        when = (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
        now = datetime.now(timezone.utc)
        if when <= now:
            raise ValueError("the time must lie in the future")
        with self._guard:
            if self.state.status in ACTIVE:
                raise RuntimeError("an update is scheduled or running already")
            self._cancel = threading.Event()
            self.state = State("waiting", uuid.uuid4().hex, when, now, caps=caps)
            self._thread = threading.Thread(target=self._run, args=(self.state, self._cancel), daemon=True)
            self._thread.start()
            return self.state

    def _run(self, job: State, cancel: threading.Event) -> None:
        utc = lambda: datetime.now(timezone.utc)
        if cancel.wait(max(0.0, (job.scheduled_for - utc()).total_seconds())) or not self._move(job.job_id, ("waiting",), status="running", started_at=utc()):
            return
        try:
            done = {"status": "completed", "result": self.update(**job.caps)}
        except Exception as e:  # noqa: BLE001
            done = {"status": "failed", "error": str(e)}
        self._move(job.job_id, ("running",), finished_at=utc(), **done)

    def cancel(self) -> State:
        """Only what waits can be cancelled."""
        with self._guard:
            if self.state.status == "waiting":
                self._cancel.set()
                self.state = replace(self.state, status="cancelled", finished_at=datetime.now(timezone.utc))
            return self.state

    def join(self, timeout: float | None = None) -> None:
        if self._thread:
            self._thread.join(timeout)

    def reset(self) -> None:
        self._cancel.set()
        self.join(1)
        with self._guard:
            self.state = State()
