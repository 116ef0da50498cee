"""A table kept as a few merged runs, so that appending often does not make reading slower.

Every append writes one run to level 0. When a level holds ``fanout`` runs they are merged into one run of the
next level, so after any number of appends at most ``fanout - 1`` runs a level are read, and a row is rewritten
once per level. Which runs count is said by a manifest of a few rows. It is written to two folders in turn and the
newer readable one holds, so a writer that dies at any point leaves the table as it was: a run that no manifest
names is not there. Folders of runs that were merged away are used again, so nothing has to be deleted and no
listing grows with the number of appends. There is one writer at a time; a reader's plan stays valid until its
runs' folders are used again, at the earliest two commits later.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "seq long, version long, level int, slot int"


@dataclass(frozen=True)
class State:
    """The ``seq``-th commit: the last version taken in, and the live runs as (level, slot)."""

    seq: int = 0
    version: int = -1
    live: frozenset = frozenset()


@dataclass
class Runs:
    """``merge`` makes one valid row of all rows of a key, for any grouping of the runs; ``schema`` is that of a run."""

    spark: SparkSession
    path: str
    schema: object
    merge: Callable[[DataFrame], DataFrame]
    fanout: int = 4
    _states: list = field(default_factory=list)

    def _stored(self, turn: int) -> State | None:
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest{turn}").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        # a manifest without runs has one row of level -1; one that broke off has none
        return State(rows[0].seq, rows[0].version, frozenset((r.level, r.slot) for r in rows if r.level >= 0)) if rows else None

    def states(self) -> list[State]:
        """The commit before the last one and the last one."""
        if not self._states:
            found = sorted((s for s in map(self._stored, (0, 1)) if s), key=lambda s: s.seq)
            self._states = [State(), *found][-2:] if found else [State(), State()]
        return self._states

    @property
    def state(self) -> State:
        return self.states()[-1]

    def _commit(self, version: int, live: frozenset) -> None:
        now = State(self.state.seq + 1, version, live)
        runs = [F.struct(F.lit(level).alias("level"), F.lit(slot).alias("slot")) for level, slot in sorted(live) or [(-1, 0)]]
        one = self.spark.range(1, numPartitions=1).select(F.lit(now.seq).cast("long").alias("seq"), F.lit(version).cast("long").alias("version"), F.inline(F.array(*runs)))
        one.write.mode("overwrite").parquet(f"{self.path}/manifest{now.seq % 2}")
        self._states = [self.state, now]

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/level{run[0]}/slot{run[1]}"

    def _write(self, rows: DataFrame, level: int) -> tuple[int, int]:
        """A run in the first folder of its level that neither of the last two manifests names."""
        taken = {slot for s in self.states() for at, slot in s.live if at == level}
        run = (level, next(i for i in range(2 * self.fanout + 2) if i not in taken))
        rows.write.mode("overwrite").parquet(self._folder(run))
        return run

    def _rows(self, live) -> DataFrame:
        out = None
        for run in sorted(live):
            rows = self.spark.read.schema(self.schema).parquet(self._folder(run))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def add(self, rows: DataFrame, version: int) -> bool:
        """Append the rows of a version. A version taken in before is left out, so a repeated one is harmless."""
        if version <= self.state.version:
            return False
        run = self._write(rows, 0)
        self._commit(version, self.state.live | {run})
        self.compact()
        return True

    def compact(self) -> None:
        """Merge full levels, each in a commit of its own."""
        for level in range(1 + max((at for at, _ in self.state.live), default=-1) + 1):
            full = frozenset(run for run in self.state.live if run[0] == level)
            if len(full) >= self.fanout:
                merged = self._write(self.merge(self._rows(full)), level + 1)
                self._commit(self.state.version, (self.state.live - full) | {merged})

    def replace(self, rows: DataFrame, version: int) -> bool:
        """Put ``rows``, made from this table's, in place of all runs."""
        if version <= self.state.version:
            return False
        top = max((at for at, _ in self.state.live), default=0)
        self._commit(version, frozenset({self._write(rows, top)}))
        return True

    def read(self) -> DataFrame:
        """The merged rows."""
        live = self.state.live
        rows = self._rows(live)
        return rows if len(live) == 1 else self.merge(rows)
