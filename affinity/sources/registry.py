"""Loaded inputs, shared by name and counted.

Loading writes tables to the shared folder.  A handle keeps them: ``release``
between jobs leaves them alone, the last handle that closes deletes them, and
the next ``acquire`` loads again.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import NamedTuple

from pyspark.sql import SparkSession

from ..session import hold, let_go, recorded
from .inputs import Inputs


class _Entry(NamedTuple):
    inputs: Inputs
    paths: list[str]
    handles: set


class Handle:
    """A use of loaded inputs; ``close`` it, or use it in a ``with`` block."""

    def __init__(self, registry: InputRegistry, spark: SparkSession, key: Hashable, inputs: Inputs):
        self._registry, self._spark, self._key, self.inputs = registry, spark, key, inputs

    def close(self) -> None:
        self._registry._drop(self._spark, self._key, self)

    def __enter__(self) -> Inputs:
        return self.inputs

    def __exit__(self, *_) -> None:
        self.close()


class InputRegistry:
    """Inputs by (session, key).  A new session, or a restarted application, loads its own."""

    def __init__(self):
        self._entries: dict[tuple, _Entry] = {}

    @staticmethod
    def _place(spark: SparkSession, key: Hashable) -> tuple:
        return id(spark), spark.sparkContext.applicationId, key

    def acquire(self, spark: SparkSession, key: Hashable, load: Callable[[], Inputs]) -> Handle:
        """A handle on the inputs of ``key``, loaded if nobody has them yet."""
        place = self._place(spark, key)
        entry = self._entries.get(place)
        if entry is None:
            with recorded(spark) as paths:
                inputs = load()
            hold(spark, paths)
            entry = self._entries[place] = _Entry(inputs, paths, set())
        handle = Handle(self, spark, key, entry.inputs)
        entry.handles.add(handle)
        return handle

    def handles(self, spark: SparkSession, key: Hashable) -> int:
        entry = self._entries.get(self._place(spark, key))
        return len(entry.handles) if entry else 0

    def _drop(self, spark: SparkSession, key: Hashable, handle: Handle) -> None:
        place = self._place(spark, key)
        entry = self._entries.get(place)
        if entry is None or handle not in entry.handles:
            return
        entry.handles.discard(handle)
        if not entry.handles:
            del self._entries[place]
            let_go(spark, entry.paths)
