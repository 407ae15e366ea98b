"""Progress of a run as measured by Spark while rows go by: phases only go on, counts only grow.

`watched` puts an observation of rows and bytes into a plan under a phase's name. In a
batch job its figures come with the job's end, in a stream with every micro-batch. No
pass over the data is made for them.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .runs import PHASES


@dataclass(frozen=True)
class Step:
    phase: str
    files: int
    bytes: int


class Progress:
    """Steps (phase, files, bytes) told to a callback; a step that would go back is left out."""

    def __init__(self, tell: Callable[[Step], None] | None = None):
        self.steps: list[Step] = []
        self.tell = tell
        self.totals: dict[str, tuple[int, int]] = {}
        self.lock = threading.Lock()
        self.heard: dict[str, threading.Event] = defaultdict(threading.Event)

    def settle(self, phase: str, seconds: float = 30) -> bool:
        """Waits until something was told of a phase: a listener hears of a batch a little after its end."""
        return self.heard[phase].wait(seconds)

    def add(self, phase: str, files: int, size: int) -> None:
        """files and bytes that a phase has done since it was last told."""
        if phase not in PHASES:
            raise ValueError(f"no phase {phase}")
        with self.lock:
            f, b = self.totals.get(phase, (0, 0))
            step = Step(phase, f + max(0, files), b + max(0, size))
            self.totals[phase] = (step.files, step.bytes)
            last = self.steps[-1] if self.steps else None
            if last is not None and (PHASES.index(phase) < PHASES.index(last.phase) or step == last):
                return
            self.steps.append(step)
        if self.tell is not None:
            self.tell(step)
        self.heard[phase].set()


def _measures(size: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")]


def watched(df: DataFrame, phase: str, size: Column, progress: Progress | None = None) -> DataFrame:
    """df, observed under the phase's name; with `progress` a batch plan's figures go there when its job ends, without it a listener hears them."""
    if progress is None:
        return df.observe(phase, *_measures(size))
    seen = Observation(phase)
    out = df.observe(seen, *_measures(size))

    def wait() -> None:
        got = seen.get  # blocks until an action has gone through
        progress.add(phase, got["files"], got["bytes"])

    threading.Thread(target=wait, daemon=True).start()
    return out


class Listener(StreamingQueryListener):
    """Feeds the observations of micro-batches to the progress of the stream with a name."""

    def __init__(self, progress: dict[str, Progress]):
        self.progress = progress

    def onQueryStarted(self, event: object) -> None:
        if own := self.progress.get(event.name):
            own.add(PHASES[0], 0, 0)

    def onQueryProgress(self, event: object) -> None:
        if own := self.progress.get(event.progress.name):
            seen = event.progress.observedMetrics
            for phase in sorted((p for p in seen if p in PHASES), key=PHASES.index):
                own.add(phase, seen[phase]["files"], seen[phase]["bytes"])

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass
