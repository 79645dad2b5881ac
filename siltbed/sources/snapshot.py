"""Snapshots: which runs make up the table, in order, and the next numbers to give out."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltbed.model import StoreError
from siltbed.sources.files import Folder

_FOLDER = "_snapshots"


@dataclass(frozen=True)
class Snapshot:
    """``runs`` is ordered from old to new; order, not the number in a name, decides which run is newer. ``streams`` has the last
    micro-batch of each stream that is in the table."""

    number: int = 0
    next_run: int = 0
    next_segment: int = 0
    next_seq: int = 1
    pending_writes: int = 0
    runs: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)

    def names(self) -> set[str]:
        """The folders of its runs and segments."""
        return {n.split("@")[0] for n in (*self.runs, *self.segments)}


def read(folder: Folder) -> Snapshot:
    """The newest snapshot; an empty one if there is none yet."""
    names = [n for n in folder.list(_FOLDER) if n.endswith(".json")]
    return Snapshot(**json.loads(folder.read(f"{_FOLDER}/{names[-1]}"))) if names else Snapshot()


def commit(folder: Folder, old: Snapshot, **changes) -> Snapshot:
    """Stores the successor of ``old``, all or nothing; fails if another writer has stored one."""
    new = replace(old, number=old.number + 1, **changes)
    if not folder.write_new(f"{_FOLDER}/{new.number:012d}.json", json.dumps(asdict(new))):
        raise StoreError("another writer committed first")
    return new


def every(folder: Folder) -> list[tuple[str, Snapshot]]:
    """All snapshots that are there, from old to new, with their files."""
    names = [f"{_FOLDER}/{n}" for n in folder.list(_FOLDER) if n.endswith(".json")]
    return [(n, Snapshot(**json.loads(folder.read(n)))) for n in names]


_RUN_ID = re.compile(r"(?:^|/)(?:data|compact)-([0-9]+)(?:\.|$)")


def repaired(folder: Folder, snapshot: Snapshot) -> Snapshot:
    """``snapshot`` with a next run number above those of all runs it names or that lie in the folder."""
    found = [_RUN_ID.search(n) for n in (*snapshot.runs, *folder.list("runs"))]
    return replace(snapshot, next_run=max([snapshot.next_run, *(int(m[1]) + 1 for m in found if m)]))


def run_id(path: Column) -> Column:
    """The number in a run's file name: its last part after exactly one hyphen, with or without the suffix; else null."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), "-")
    return F.when(F.size(parts) == 2, F.regexp_replace(F.element_at(parts, 2), r"\.sst$", "").try_cast("long"))


def safe_next(next_id: Column, greatest: Column) -> Column:
    """``next_id``, or what follows the greatest id in use if that is larger."""
    return F.greatest(next_id, F.coalesce(greatest + 1, next_id))
