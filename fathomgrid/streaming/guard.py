"""A guard over long runs: it samples the driver machine's memory and disk, and cancels the jobs of a run that goes beyond its limits."""

from __future__ import annotations

import shutil
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


class Aborted(RuntimeError):
    """A run that its guard cancelled."""


def memory_of(path: str = "/proc/meminfo") -> int:
    """Bytes of memory that are available."""
    with open(path) as f:
        for line in f:
            if line.startswith("MemAvailable:"):
                return int(line.split()[1]) * 1024
    raise OSError("no figure of available memory")


@dataclass
class Guard:
    """STR-5: limits, and what was sampled: the least memory and disk that were left, and how often."""

    least_memory: int = 512 << 20
    least_disk: int = 1 << 30
    folder: str = "/"
    every: float = 1.0
    memory: Callable[[], int] = memory_of
    disk: Callable[[], int] | None = None
    samples: int = 0
    lowest_memory: int | None = None
    lowest_disk: int | None = None
    reason: str | None = field(default=None)

    def sample(self) -> str | None:
        memory = self.memory()
        disk = self.disk() if self.disk else shutil.disk_usage(self.folder).free
        self.samples += 1
        self.lowest_memory = memory if self.lowest_memory is None else min(memory, self.lowest_memory)
        self.lowest_disk = disk if self.lowest_disk is None else min(disk, self.lowest_disk)
        if memory < self.least_memory:
            return f"{memory} bytes of memory are left, {self.least_memory} are the least"
        if disk < self.least_disk:
            return f"{disk} bytes of disk are left, {self.least_disk} are the least"
        return None

    def run(self, spark: SparkSession, work: Callable[[], Any]) -> Any:
        """What ``work`` returns; ``Aborted`` if a limit was passed, with its Spark jobs cancelled."""
        context, tag = spark.sparkContext, f"guard-{uuid.uuid4().hex}"
        done = threading.Event()

        def watch():
            while not done.is_set():
                self.reason = self.reason or self.sample()
                if self.reason:
                    context.cancelJobsWithTag(tag)
                done.wait(self.every)

        self.reason = self.sample()
        if self.reason:
            raise Aborted(self.reason)
        context.addJobTag(tag)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            out = work()
        except Exception as e:
            if self.reason:
                raise Aborted(self.reason) from e
            raise
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)
        if self.reason:
            raise Aborted(self.reason)
        return out
