"""Multinomial logistic regression for many training sets of the same rows at once.

A cell is a training set: rows with a weight. All cells' weights are stacked, so that one pass over
the rows gives every cell's loss and gradient at a point of its own; a task sends one row per
cell, and these are added up in two steps. Directions (limited-memory BFGS) and step lengths
are chosen per cell on the driver from vectors of (classes x features). So the number of passes is
that of the slowest cell and does not grow with the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffline.functions.arrays import as_matrix

#: Values of (rows x cells x classes) that a task holds at once.
VALUES_AT_ONCE = 4 << 20
#: Groups in which the tasks' sums meet first.
SALTS = 32
#: Steps that the directions remember.
MEMORY = 10
#: Share of the promised decrease that a step must reach, and the shortest step tried.
ENOUGH, SHORTEST = 1e-4, 1e-6

_SUM = "cell int, loss double, weight double, gradient binary"


def losses(rows: np.ndarray, own: np.ndarray, share: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed cross entropy (cells) and its gradient (cells, classes, features).

    `own` is each row's class, `share` its weight in each cell (rows, cells), and `weights` has the
    shape of the gradient.
    """
    cells, classes, width = weights.shape
    total, gradient = np.zeros(cells), np.zeros_like(weights)
    step = max(1, VALUES_AT_ONCE // (cells * classes))
    for at in range(0, len(rows), step):
        x, y, s = rows[at : at + step], own[at : at + step], share[at : at + step]
        chances = log_chances(x, weights)
        total -= (s * chances[np.arange(len(x)), :, y]).sum(0)
        chances = np.exp(chances)
        chances[np.arange(len(x)), :, y] -= 1
        chances *= s[:, :, None]
        gradient += (chances.reshape(len(x), -1).T @ x).reshape(weights.shape)
    return total, gradient


def log_chances(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(rows, cells, classes): logarithms of the classes' probabilities."""
    cells, classes, width = weights.shape
    found = (rows @ weights.reshape(-1, width).T).reshape(len(rows), cells, classes)
    found -= found.max(2, keepdims=True)
    found -= np.log(np.exp(found).sum(2, keepdims=True))
    return found


def _added(group: pa.Table) -> pa.Table:
    gradients = [np.frombuffer(g, np.float64) for g in group["gradient"].to_pylist()]
    return pa.table(
        {
            "cell": group["cell"][:1], "loss": [float(np.sum(group["loss"].to_numpy()))],
            "weight": [float(np.sum(group["weight"].to_numpy()))], "gradient": [np.sum(gradients, axis=0).tobytes()],
        }
    )


def evaluate(members: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Losses, sums of weights and gradients of all cells, in one pass over the members.

    `members` holds (features with a 1 at the end, class, cells, weights), the last two being lists
    of the cells that have the row.
    """
    sent = members.sparkSession.sparkContext.broadcast(weights)
    cells = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, weight, gradient = np.zeros(cells), np.zeros(cells), np.zeros_like(sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("cells")
            share = np.zeros((batch.num_rows, cells))
            share[np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets)), np.asarray(lists.flatten())] = np.asarray(
                batch.column("weights").flatten()
            )
            own = losses(as_matrix(batch.column("features")), np.asarray(batch.column("class")), share, sent.value)
            loss, gradient, weight = loss + own[0], gradient + own[1], weight + share.sum(0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(cells), pa.int32()), pa.array(loss), pa.array(weight),
                pa.array([g.tobytes() for g in gradient], pa.binary()),
            ],
            names=["cell", "loss", "weight", "gradient"],
        )

    parts = members.select("features", "class", "cells", "weights").mapInArrow(run, _SUM)
    salted = parts.groupBy("cell", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"))
    found = salted.applyInArrow(_added, _SUM).groupBy("cell").applyInArrow(_added, _SUM).orderBy("cell").toArrow()
    gradient = np.array([np.frombuffer(g, np.float64) for g in found["gradient"].to_pylist()]).reshape(weights.shape)
    return found["loss"].to_numpy(), found["weight"].to_numpy(), gradient


@dataclass
class Descent:
    """Where one cell is: its best point, its direction and the length of the step it tries."""

    point: np.ndarray
    value: float = np.inf
    slope: np.ndarray | None = None
    direction: np.ndarray | None = None
    length: float = 0.0
    moves: list = field(default_factory=list)
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.point if self.direction is None or self.done else self.point + self.length * self.direction

    def note(self, value: float, slope: np.ndarray, tolerance: float) -> None:
        """Take or refuse the trial point, and choose the next one."""
        if self.done:
            return
        if self.direction is not None:
            promised = ENOUGH * self.length * float((self.slope * self.direction).sum())
            if not value <= self.value + promised:
                self.length /= 2
                self.done = self.length < SHORTEST
                return
            move, turn = self.length * self.direction, slope - self.slope
            if (move * turn).sum() > 1e-12 * (turn * turn).sum():
                self.moves = [*self.moves[1 - MEMORY :], (move, turn)]
            self.point = self.point + move
        self.value, self.slope = value, slope
        self.done = float(np.abs(slope).max(initial=0.0)) <= tolerance
        self.direction, self.length = -self._turned(slope), 1.0
        if (self.direction * slope).sum() >= 0:
            self.direction, self.moves = -slope, []

    def _turned(self, slope: np.ndarray) -> np.ndarray:
        """The slope times the remembered inverse curvature."""
        out, kept = slope.copy(), []
        for move, turn in reversed(self.moves):
            scale = (move * out).sum() / (move * turn).sum()
            out -= scale * turn
            kept.append(scale)
        if self.moves:
            move, turn = self.moves[-1]
            out *= (move * turn).sum() / (turn * turn).sum()
        for (move, turn), scale in zip(self.moves, reversed(kept)):
            out += move * (scale - (turn * out).sum() / (move * turn).sum())
        return out


def fit_cells(
    members: DataFrame, cells: int, classes: int, width: int, penalty: float, passes: int, tolerance: float
) -> tuple[np.ndarray, int]:
    """The weights (cells, classes, width) of all cells, and how many passes they took.

    Each cell minimises its mean cross entropy plus penalty / 2 times the squares of its weights, but
    for the last feature's, which is the constant. A cell without rows keeps zero weights.
    """
    states = [Descent(np.zeros((classes, width))) for _ in range(cells)]
    used = 0
    while used < passes and not all(s.done for s in states):
        trials = np.array([s.trial() for s in states])
        total, weight, gradient = evaluate(members, trials)
        used += 1
        inner = trials.copy()
        inner[:, :, -1] = 0
        share = np.maximum(weight, 1e-300)
        values = total / share + penalty / 2 * np.square(inner).sum((1, 2))
        slopes = gradient / share[:, None, None] + penalty * inner
        for state, value, slope in zip(states, values, slopes):
            state.note(float(value), slope, tolerance)
    return np.array([s.point for s in states]), used
