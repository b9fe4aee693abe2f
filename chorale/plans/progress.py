"""Progress of an action over chunks, told to a listener on the driver."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")


class Progress:
    """Calls listener(done, total) once for each chunk, done rising from 1 to total, while `run` is under way.

    Workers count chunks in an accumulator, whose value comes in as tasks end, so calls come in groups. A task that is run again,
    after a lost executor or by speculation, counts again; done stops at total therefore, and only an action that has succeeded
    brings it there: one that fails leaves the last chunk untold. A listener's error stops the telling, not the action, and is
    raised after it. Without chunks there is no call.
    """

    def __init__(self, spark: SparkSession, listener: Callable[[int, int], None], seconds: float = 0.2):
        self.listener, self.seconds, self.total, self.told = listener, seconds, 0, 0
        self.done = spark.sparkContext.accumulator(0)

    def expect(self, chunks: DataFrame) -> None:
        """Counts chunks that are yet to come, in a pass that reads no samples; a plan may add several times."""
        self.total += chunks.count()

    def _tell(self, done: int) -> None:
        while self.told < min(done, self.total):
            self.told += 1
            self.listener(self.told, self.total)

    def run(self, action: Callable[[], Result]) -> Result:
        """The action's result; the listener is called from another thread meanwhile, and from this one at the end."""
        over, failed = threading.Event(), []

        def watch() -> None:
            try:
                while not over.wait(self.seconds):
                    self._tell(min(self.done.value, self.total - 1))
            except Exception as e:  # the listener's; kept for the caller
                failed.append(e)

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            out = action()
        finally:
            over.set()
            thread.join()
        if failed:
            raise failed[0]
        self._tell(self.total)
        return out
