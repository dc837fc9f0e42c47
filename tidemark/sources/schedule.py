"""When to build: a sensor of new files and a daily time in a zone, which start each run once however many processes look."""

from __future__ import annotations

import hashlib
import json
import time as clock
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from tidemark.schemas import RAW
from tidemark.sources.commits import CommitLog, ConflictError
from tidemark.sources.loader import Loader


@dataclass
class Runs:
    """Runs by key, in a commit log: started by the first who commits that, done when their work is.

    A run that was started and neither done nor failed within `lease` seconds is taken for dead, and may be started again;
    so may one that failed.
    """

    log: CommitLog
    lease: float = 6 * 3600.0
    now: Callable[[], float] = clock.time
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)

    def get(self, key: str) -> dict | None:
        return json.loads(self.log.state().values.get(f"run/{key}", "null"))

    def _set(self, key: str, state: str, **more: str) -> None:
        seen = self.log.state()
        held = json.loads(seen.values.get(f"run/{key}", "null"))
        if state != "started" and (held or {}).get("owner") != self.owner:
            return  # the lease ran out and another has it now
        self.log.commit(seen, {f"run/{key}": json.dumps({"state": state, "owner": self.owner, "at": self.now()} | more)})

    def once(self, key: str, work: Callable[[], object], cursor: str | None = None) -> bool:
        """Does the work unless the run is done or someone is at it; whether it did."""
        seen = self.log.state()
        held = json.loads(seen.values.get(f"run/{key}", "null"))
        if held and (held["state"] == "done" or held["state"] == "started" and self.now() - held["at"] < self.lease):
            return False
        put = {f"run/{key}": json.dumps({"state": "started", "owner": self.owner, "at": self.now()})}
        try:
            self.log.commit(seen, put | ({"cursor": cursor} if cursor else {}))
        except ConflictError:
            return False
        try:
            work()
        except Exception as e:
            self._set(key, "failed", error=str(e)[:500])
            raise
        self._set(key, "done")
        return True


@dataclass
class Sensor:
    """Tells whether files have landed since the last look. The cursor, the newest modification time and the number of files
    that were there, is kept in the log of `runs`."""

    loader: Loader
    runs: Runs | None = None
    running: bool = False

    def look(self, cursor: str | None) -> tuple[bool, str]:
        """(whether to build, the next cursor)."""
        files = None
        for entity in RAW:
            one = self.loader.discover(entity)
            files = one if files is None else files.unionByName(one)
        now = files.agg(F.count("*").alias("files"), F.max("file_mtime").alias("newest")).first()
        found = json.dumps({"files": now["files"], "newest": now["newest"].isoformat() if now["newest"] else None})
        return self.running and now["files"] > 0 and found != cursor, found

    def tick(self, work: Callable[[], object]) -> bool:
        """Looks, and does the work if there are files that no run has seen to; whether it did. What a run has begun with is its
        key, so of several sensors over one log one starts it."""
        cursor = self.runs.log.state().values.get("cursor")
        due, found = self.look(cursor)
        key = hashlib.sha256(found.encode()).hexdigest()[:16]
        held = self.runs.get(key)
        if not due and not (self.running and found == cursor and held and held["state"] != "done"):
            return False
        return self.runs.once(key, work, found)

    def watch(self, work: Callable[[], object], seconds: float = 60.0, times: int | None = None) -> int:
        """Ticks every so many seconds, `times` times or for ever; how often it did the work."""
        done, left = 0, times
        while left is None or left > 0:
            done += self.tick(work)
            left = None if left is None else left - 1
            if left != 0:
                clock.sleep(seconds)
        return done


@dataclass(frozen=True)
class Daily:
    """A time of day in a time zone."""

    at: time = time(6, 0)
    zone: str = "Asia/Kolkata"
    running: bool = False

    def next(self, now: datetime) -> datetime | None:
        """The first such time after now (which has a zone), or None if the schedule isn't started."""
        if not self.running:
            return None
        local = now.astimezone(ZoneInfo(self.zone))
        today = datetime.combine(local.date(), self.at, ZoneInfo(self.zone))
        return today if today > local else datetime.combine(local.date() + timedelta(1), self.at, ZoneInfo(self.zone))

    def tick(self, runs: Runs, now: datetime, work: Callable[[], object]) -> bool:
        """Does the work of the last such time up to now, unless some process has; whether it did."""
        following = self.next(now)
        if following is None:
            return False
        due = following - timedelta(1)
        return runs.once(f"daily-{due.isoformat()}", work)
