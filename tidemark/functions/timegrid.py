"""Variable-resolution time grid as closed-form column expressions.

A grid is a few segments ``(start, end, width)`` counted in minutes from an entity's start.
Every entity shares the same offsets, so the cell of a point is plain arithmetic on
``ts - start``: assigning events to cells needs no join and no shuffle.

Two step functions exist and must not be mixed: ``step_of`` assigns points to half-open
cells ``[lo, hi)``; ``time_to_step`` converts an elapsed time to the step whose right-closed
cell ``(lo, hi]`` holds it (used when evaluating "at time t").
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINUTE = 60_000_000

# Default horizons and cell widths.
DEFAULT_INTERVALS = {
    "6h": "10min",
    "12h": "20min",
    "24h": "1h",
    "72h": "4h",
    "14D": "12h",
    "30D": "1D",
    "90D": "7D",
    "end": "30D",
}
DEFAULT_WIDTHS = ("10min", "20min", "1h", "4h", "12h", "1D")

_UNITS = {"min": 1, "h": 60, "D": 1440}


def minutes_of(text: str) -> int:
    """``'10min'``, ``'4h'`` or ``'14D'`` as minutes."""
    hit = re.fullmatch(r"\s*(\d+)\s*(min|h|D)\s*", text)
    if not hit:
        raise ValueError(f"not a duration: {text!r}")
    return int(hit.group(1)) * _UNITS[hit.group(2)]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (session zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    """Zone-less timestamp from microseconds."""
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def elapsed_minutes(ts: Column, start: Column) -> Column:
    return (micros(ts) - micros(start)) / F.lit(float(MINUTE))


@dataclass(frozen=True)
class Segment:
    lo: int  # nominal first minute
    hi: int | None  # nominal last minute, None for the open tail
    width: int
    label: str
    included: bool


@dataclass(frozen=True)
class Cell:
    step: int  # 0-based position among the included cells, -1 when excluded
    counter: int  # 1-based position among all cells
    lo: int
    hi: int
    label: str


@dataclass(frozen=True)
class Grid:
    intervals: dict = field(default_factory=lambda: dict(DEFAULT_INTERVALS))
    widths: tuple | None = DEFAULT_WIDTHS

    # ---- definition -------------------------------------------------------------------
    @property
    def segments(self) -> list[Segment]:
        out, lo = [], 0
        for end, width in self.intervals.items():
            hi = None if end == "end" else minutes_of(end)
            out.append(Segment(lo, hi, minutes_of(width), width, self.widths is None or width in self.widths))
            if hi is not None:
                lo = hi
        return out

    @property
    def margin(self) -> int:
        """Minutes the grid reaches past an entity's end: the widest cell."""
        return max(s.width for s in self.segments)

    @property
    def cells(self) -> list[Cell]:
        """All cells of the closed segments; a segment starts at the last edge laid before it."""
        out, edge, step = [], 0, 0
        for seg in self.segments:
            if seg.hi is None:
                continue
            while edge + seg.width <= seg.hi:
                out.append(Cell(step if seg.included else -1, len(out) + 1, edge, edge + seg.width, seg.label))
                step += seg.included
                edge += seg.width
        return out

    @property
    def tail(self) -> Segment | None:
        """The open segment, anchored at the last closed edge."""
        last = self.segments[-1]
        if last.hi is not None:
            return None
        return Segment(self.cells[-1].hi, None, last.width, last.label, last.included)

    @property
    def steps(self) -> list[Cell]:
        return [c for c in self.cells if c.step >= 0]

    @property
    def total_steps(self) -> int:
        return sum((s.hi - s.lo) // s.width for s in self.segments if s.included and s.hi is not None)

    @property
    def max_days(self) -> int:
        return max(s.hi for s in self.segments if s.included and s.hi is not None) // 1440

    def alignment(self) -> list[tuple]:
        """(lo, hi, width, whole cells, aligned) per included closed segment."""
        return [
            (s.lo, s.hi, s.width, (s.hi - s.lo) // s.width, (s.hi - s.lo) % s.width == 0)
            for s in self.segments
            if s.included and s.hi is not None
        ]

    def _runs(self) -> list[tuple[int, int, int, int]]:
        """Included cells as runs (first step, lo, hi, width) of equal width without gaps."""
        runs: list[list[int]] = []
        for c in self.steps:
            width = c.hi - c.lo
            if runs and runs[-1][3] == width and runs[-1][2] == c.lo:
                runs[-1][2] = c.hi
            else:
                runs.append([c.step, c.lo, c.hi, width])
        return [tuple(r) for r in runs]

    # ---- column expressions -----------------------------------------------------------
    def step_of(self, ts: Column, start: Column) -> Column:
        """Step whose half-open cell ``[lo, hi)`` holds ``ts``; NULL outside the grid."""
        us = micros(ts) - micros(start)
        out = F.lit(None).cast("int")
        for first, lo, hi, width in reversed(self._runs()):
            inside = (us >= lo * MINUTE) & (us < hi * MINUTE)
            step = F.lit(first) + F.floor((us - lo * MINUTE) / F.lit(width * MINUTE))
            out = F.when(inside, step.cast("int")).otherwise(out)
        return out

    def last_step_before(self, ts: Column, start: Column) -> Column:
        """Last step whose cell begins strictly before ``ts``; NULL when none does."""
        us = micros(ts) - micros(start)
        out = F.lit(None).cast("int")
        for first, lo, hi, width in self._runs():
            step = F.lit(first) + F.ceil((F.least(us, F.lit(hi * MINUTE)) - lo * MINUTE) / F.lit(width * MINUTE)) - 1
            out = F.when(us > lo * MINUTE, step.cast("int")).otherwise(out)
        return out

    def first_step_after(self, ts: Column, start: Column) -> Column:
        """First step whose cell ends strictly after ``ts``; NULL when none does."""
        us = micros(ts) - micros(start)
        out = F.lit(None).cast("int")
        for first, lo, hi, width in reversed(self._runs()):
            step = F.lit(first) + F.floor((F.greatest(us, F.lit(lo * MINUTE)) - lo * MINUTE) / F.lit(width * MINUTE))
            out = F.when(us < hi * MINUTE, step.cast("int")).otherwise(out)
        return out

    def time_to_step(self, minutes: Column) -> Column:
        """Right-closed conversion of elapsed minutes to a step; 0 at or before the start."""
        out = F.lit(None).cast("int")
        base = 0
        branches = []
        for seg in self.segments:
            if not seg.included:
                continue
            inside = minutes > seg.lo
            if seg.hi is not None:
                inside = inside & (minutes <= seg.hi)
            step = F.lit(base) + F.ceil((minutes - seg.lo) / F.lit(float(seg.width))) - 1
            branches.append((inside, step.cast("int")))
            if seg.hi is not None:
                base += (seg.hi - seg.lo) // seg.width
        for inside, step in reversed(branches):
            out = F.when(inside, step).otherwise(out)
        return F.when(minutes <= 0, F.lit(0)).otherwise(out)

    def step_to_time(self, step: Column) -> Column:
        """Right edge of a step in minutes; the step after the last maps to the horizon."""
        edges = [min(c.hi, self.steps[-1].hi) for c in self.steps] + [self.steps[-1].hi]
        # the position one past the end would extend by a width and is clamped to the horizon
        table = F.lit(edges)
        return F.when((step >= 0) & (step < len(edges)), F.element_at(table, (step + 1).cast("int")))

    def bounds(self, step: Column) -> tuple[Column, Column]:
        """(lo, hi) offsets in minutes of a step."""
        lo = F.lit([c.lo for c in self.steps])
        hi = F.lit([c.hi for c in self.steps])
        at = (step + 1).cast("int")
        return F.element_at(lo, at), F.element_at(hi, at)

    def cells_frame(self, spark: SparkSession) -> DataFrame:
        """The included cells as a small frame; its size is fixed by the configuration."""
        schema = "step int, counter int, off_start int, off_end int, bin_freq string"
        return spark.createDataFrame([(c.step, c.counter, c.lo, c.hi, c.label) for c in self.steps], schema)


DEFAULT_GRID = Grid()
