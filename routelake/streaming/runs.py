"""Incremental builds and superseding runs."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(inputs: dict[str, str], params: dict) -> str:
    return hashlib.sha256(json.dumps([inputs, params], sort_keys=True, default=str).encode()).hexdigest()


def stale(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Tasks (task, fingerprint) whose last good run (task, fingerprint) had another fingerprint, or that never ran."""
    return tasks.join(done, ["task", "fingerprint"], "left_anti")


class Superseding:
    """Runs one query at a time for a client: a new one cancels that which still runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, None

    def run(self, make):
        if self.tag:
            self.spark.interruptTag(self.tag)
        self.tag = f"run-{uuid.uuid4().hex}"
        self.spark.addTag(self.tag)
        try:
            return make()
        finally:
            self.spark.removeTag(self.tag)


def timings(log: DataFrame) -> DataFrame:
    """(phase, runs, last_s, median_s) of a log (phase, at, seconds)."""
    return log.groupBy("phase").agg(F.count("*").alias("runs"), F.max_by("seconds", "at").alias("last_s"), F.median("seconds").alias("median_s"))


class Debounced:
    """Runs the last of requests that come in quick succession, and keeps the last result until the next is there."""

    def __init__(self, run, seconds: float = 0.3):
        self.run, self.seconds, self.result, self._timer, self._lock = run, seconds, None, None, threading.Lock()

    def ask(self, *args) -> None:
        with self._lock:
            if self._timer:
                self._timer.cancel()
            self._timer = threading.Timer(self.seconds, self._answer, args)
            self._timer.daemon = True
            self._timer.start()

    def _answer(self, *args) -> None:
        self.result = self.run(*args)

    def wait(self):
        if self._timer:
            self._timer.join()
        return self.result


class Once:
    """Keeps what make() gave for a key; a failure is not kept."""

    def __init__(self):
        self._known, self._locks, self._lock = {}, {}, threading.Lock()

    def get(self, key, make):
        with self._lock:
            own = self._locks.setdefault(key, threading.Lock())
        with own:
            if key not in self._known:
                self._known[key] = make()
            return self._known[key]
