"""Autofocus as a session: each image of a run answers with where to move the focuser and whether to shoot again.

A run is a machine that is fed with the star sizes of its images, in order. It remembers the positions still to be measured, the
samples taken, the sizes seen at the present position and how many images in a row had no stars. The stream form keeps one machine
for each run in Structured Streaming state, the batch form replays recorded runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import _focus

#: Images in a row without stars after which a position, and all others, are given up (fixed values).
POSITION_TRIES, ALL_TRIES = 4, 8
COMMANDS = "run long, image long, k int, command string, position double"


@dataclass(frozen=True)
class Options:
    """measures: positions of a stage, `step` apart. backlash: steps by which a first move goes too low, so that the last one goes up.

    shots: images a position, of which the smallest size counts. preliminary: whether a stage that may ask for more measures
    goes before the final one. low, high: where the focuser can go. restore: what is said when no focus is found: go back, or fail.
    """

    measures: int = 5
    step: float = 100.0
    backlash: float = 0.0
    shots: int = 1
    preliminary: bool = True
    low: float = -math.inf
    high: float = math.inf
    restore: bool = True


def shots_of(exposure: float) -> int:
    """Images a position: as many as fit ten seconds, one to three."""
    return min(max(10 // max(int(exposure), 1), 1), 3)


@dataclass
class Run:
    before: float
    stage: str = "first"
    target: float = 0.0
    to_go: list[float] = field(default_factory=list)
    xs: list[float] = field(default_factory=list)
    ys: list[float] = field(default_factory=list)
    sizes: list[float] = field(default_factory=list)
    tries: int = 0
    images: int = 0

    def image(self, hfd: float | None, o: Options) -> list[tuple[str, float]]:
        """The commands that answer one more image, whose star size is None where it has no stars."""
        self.images += 1
        if self.stage == "first":
            return self._stage(self.before, "preliminary" if o.preliminary else "final", o)
        if self.stage == "result":
            self.stage = "done"
            return [("done", self.target)]
        return self._measure(hfd, o) if self.stage in ("preliminary", "final") else []

    def _stage(self, middle: float, stage: str, o: Options) -> list[tuple[str, float]]:
        self.xs, self.ys, self.stage = [], [], stage
        self.to_go = [middle + o.step * (k - (o.measures - 1) / 2) for k in range(o.measures)]
        return self._next(o, True)

    def _next(self, o: Options, from_below: bool) -> list[tuple[str, float]]:
        if not self.to_go:
            return []
        self.target = self.to_go.pop(0)
        first = [("move", max(self.target - o.backlash, 0.0))] if from_below else []
        return [*first, ("move", self.target), ("shot", self.target)]

    def _measure(self, hfd: float | None, o: Options) -> list[tuple[str, float]]:
        added = False
        if hfd is not None:
            self.tries = 0
            self.sizes.append(hfd)
            if len(self.sizes) < o.shots:
                return [("shot", self.target)]
            at = int(np.searchsorted(self.xs, self.target, side="right"))
            self.xs.insert(at, self.target)
            self.ys.insert(at, min(self.sizes))
            self.sizes, added = [], True
        else:
            self.tries += 1
        enough = self.tries >= ALL_TRIES and bool(self.xs)
        if not (added or self.tries >= POSITION_TRIES or enough):
            return [("shot", self.target)]
        if self.to_go and not enough:
            return self._next(o, False)
        self.to_go = []
        return self._result(o)

    def _result(self, o: Options) -> list[tuple[str, float]]:
        x, y = np.array(self.xs), np.array(self.ys)
        outcome, position, more = _focus(x, y, o.measures, o.step, self.stage == "preliminary", o.low, o.high) if len(x) else ("failed", None, [])
        position = None if position is None else float(position)
        if outcome == "found" and self.stage == "preliminary":
            return self._stage(position, "final", o)
        if outcome in ("rising", "falling"):
            self.to_go = [float(p) for p in more]
            return self._next(o, True)
        if outcome == "failed" and not o.restore:
            self.stage = "failed"
            return [("fail", self.before)]
        self.stage, self.target = "result", self.before if outcome == "failed" else position
        below = float(math.floor(max(self.target - o.backlash, 0.0) + 0.5))
        return [("move", below), ("move", self.target), ("shot", self.target)]


STATE = "before double, stage string, target double, to_go array<double>, xs array<double>, ys array<double>, sizes array<double>, tries int, images long"


def _answers(run: Run, key: int, rows: pd.DataFrame, options: Options) -> list[tuple]:
    out = []
    for hfd in rows["hfd"]:
        commands = run.image(None if hfd is None or hfd != hfd else float(hfd), options)
        out += [(key, run.images - 1, k, *c) for k, c in enumerate(commands)]
    return out


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COMMANDS.split(", ")])


class _Session(StatefulProcessor):
    def __init__(self, options: Options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        images = pd.concat(list(rows)).sort_values("image", kind="stable")
        if self.state.exists():
            kept = self.state.get()
            run = Run(kept[0], kept[1], kept[2], *[list(a or []) for a in kept[3:7]], kept[7], kept[8])
        else:
            run = Run(float(images["position"].iloc[0]))
        images = images[images["image"] >= run.images].drop_duplicates("image")
        out = _answers(run, key[0], images, self.options)
        self.state.update((run.before, run.stage, run.target, run.to_go, run.xs, run.ys, run.sizes, run.tries, run.images))
        if out:
            yield _table(out)


def _images(images: DataFrame) -> DataFrame:
    return images.selectExpr("cast(run as long) run", "cast(image as long) image", "cast(position as double) position", "cast(hfd as double) hfd").where("image IS NOT NULL")


def focus_session(images: DataFrame, options: Options) -> DataFrame:
    """COMMANDS rows for a stream of images (run, image, position, hfd), numbered from 0 in each run; hfd is null without stars.

    The position of a run's first image is where it returns to. Commands are those of the image they answer, in the order k: move
    the focuser, shoot, done or fail. An image that was answered before is left out, so a source that repeats images does no harm.
    State is one machine a run: the samples of one stage at most.
    """
    return _images(images).groupBy("run").transformWithStateInPandas(_Session(options), COMMANDS, "Append", "None")


def replay(images: DataFrame, options: Options) -> DataFrame:
    """What focus_session() gives for recorded runs; a run's images are few by design."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("image", kind="stable").drop_duplicates("image")
        return _table(_answers(Run(float(rows["position"].iloc[0])), rows["run"].iloc[0], rows, options))

    return _images(images).groupBy("run").applyInPandas(one, COMMANDS)
