"""A bounded store of what a function gave, for words that return again and again."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memo(dict):
    """Two generations: when the young one is full it becomes the old one, so words that are met
    often stay and memory is bounded, whatever the number of different words."""

    def __init__(self, make: Callable, size: int = 200_000):
        self.make, self.size = make, size
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def all(self, keys: Iterable) -> list:
        return list(map(self.__getitem__, keys))
