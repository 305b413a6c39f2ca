"""Clusterings of one study that were made already, and signs of life of long studies."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.leiden import TASKS

logger = logging.getLogger("concord")


class Memo:
    """Runs of Leiden by what determines them: resolution, seed and settings. Starting labels are no part of it.

    Labels stay in the tables that the first run was written to; only the keys of runs are held here.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.tables: list[DataFrame] = []
        self.found: dict[tuple, tuple[int, int, int]] = {}

    @property
    def entries(self) -> int:
        return len(self.found)

    def cluster(self, tasks: DataFrame, settings: tuple, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Labels of ``tasks``; ``run`` makes and stores those that are missing."""
        spark = tasks.sparkSession
        rows = [tuple(r) for r in tasks.select("task", "gamma", "trial", "seed").collect()]
        known: dict[int, list[tuple[int, int, int, int]]] = {}
        new = []
        for task, gamma, trial, seed in rows:
            place = self.found.get((gamma, seed, *settings))
            if place is None:
                new.append((task, gamma, trial, seed))
            else:
                known.setdefault(place[0], []).append((*place[1:], task, trial))
        out = None
        if new or not rows:
            out = run(spark.createDataFrame(new, TASKS))
            self.tables.append(out)
            for task, gamma, trial, seed in new:
                self.found[(gamma, seed, *settings)] = (len(self.tables) - 1, task, trial)
        for table, links in known.items():
            named = F.broadcast(spark.createDataFrame(links, "task int, trial int, new_task int, new_trial int"))  # a row for each run
            labels = self.tables[table].join(named, ["task", "trial"]).select(F.col("new_task").alias("task"), F.col("new_trial").alias("trial"), "cell_idx", "label")
            out = labels if out is None else out.unionByName(labels)
        return out


class Heartbeat:
    """Logs a message at most once in ``seconds``; a message may be a function, called only if it is logged."""

    def __init__(self, context: str = "", seconds: float = 60.0, enabled: bool = True):
        usable = isinstance(seconds, (int, float)) and not isinstance(seconds, bool) and math.isfinite(seconds) and seconds > 0
        self.context, self.seconds, self.enabled = context, float(seconds) if usable else 60.0, enabled
        self.last = time.monotonic()

    def __call__(self, message: str | Callable[[], str]) -> bool:
        now = time.monotonic()
        if not self.enabled or now - self.last < self.seconds:
            return False
        self.last = now
        said = message() if callable(message) else message
        logger.info("%sheartbeat (%gs): %s", f"{self.context} " if self.context else "", self.seconds, said or "progress update")
        return True
