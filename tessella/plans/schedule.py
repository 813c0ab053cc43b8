"""Groups of Spark actions: those of a group run side by side, groups one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_groups(spark: SparkSession, groups: Iterable[Iterable[Callable[[], Any]]], threads: int = 8) -> list[list[Any]]:
    """The results of all actions, in order. The first failure is raised; later groups and what has not begun do not run."""
    out = []
    with ThreadPoolExecutor(threads) as pool:
        for group in groups:
            futures = [pool.submit(inheritable_thread_target(spark)(f)) for f in group]
            _, left = wait(futures, return_when=FIRST_EXCEPTION)
            for f in left:
                f.cancel()
            out.append([f.result() for f in futures if not f.cancelled()])
    return out
