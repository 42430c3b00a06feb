"""Progress of a run, logged while Spark works."""

from __future__ import annotations

import logging
import threading
import time

from pyspark.sql import SparkSession


class Progress:
    """Logs lines read and time passed while stages run; level 2: after each ``lines`` lines, level 3: every ``seconds`` as well.

    A thread asks the driver's own records of the stages that run for the rows that their tasks have read so far; tasks report them with
    every heartbeat and when they end. ``total`` is the number of lines, if it is known; it may be set later. Nothing is added to the jobs.
    """

    def __init__(self, spark: SparkSession, log: logging.Logger, level: int, total: int | None = None, lines: int = 200_000, seconds: float = 5.0, wait: float = 0.5):
        self.log, self.level, self.total, self.lines, self.seconds, self.wait = log, level, total, lines, seconds, wait
        self.context, self.name, self.began = spark.sparkContext, "", time.monotonic()
        self._seen, self._since, self._end = 0, self.began, threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def __enter__(self) -> Progress:
        if self.level > 1:
            self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        if self.level > 1:
            self._thread.join()

    def stage(self, name: str) -> None:
        """From now on ``name`` is done."""
        self.name, self._seen = name, 0
        if self.level > 1:
            self.log.debug("stage: %s", name)

    def read(self) -> int:
        """Rows that the stages which run now have read from their source."""
        store, jvm = self.context._jsc.sc().statusStore(), self.context._jvm
        active = jvm.java.util.ArrayList()
        active.add(jvm.org.apache.spark.status.api.v1.StageStatus.ACTIVE)
        stages = store.stageList(active, False, False, self.context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    def _watch(self) -> None:
        while not self._end.wait(self.wait):
            try:
                n = self.read()
            except Exception as e:  # the session may be ending; progress is no reason to fail
                self.log.debug("progress is not known: %s", e)
                return
            now = time.monotonic()
            if n < self._seen:  # another stage
                self._seen = 0
            if n // self.lines > self._seen // self.lines or (self.level > 2 and n and now - self._since >= self.seconds):
                self._seen, self._since = n, now
                part = f"{100 * n / self.total:.2f}%" if self.total else "UNKNOWN%"
                whole = f"{self.total:,}" if self.total else "UNKNOWN"
                self.log.debug("%s finished - %s lines out of %s, %.1f s, %s", part, f"{n:,}", whole, now - self.began, self.name)
