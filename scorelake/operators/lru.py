"""A cache of built objects inside a worker."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any


class LRUCache(ABC):
    """Keeps the ``cache_size`` objects used last; a dict's order is the order of use. Size 0 or less keeps nothing."""

    def __init__(self, cache_size: int = 1):
        self.cache_size = cache_size
        self.cache: dict = {}

    @abstractmethod
    def create(self, key: Any) -> Any:
        """The object for a key."""

    def cleanup(self, key: Any, obj: Any) -> None:
        """Called with what is evicted."""

    def get(self, key: Any) -> Any:
        if self.cache_size <= 0:
            return self.create(key)
        if key in self.cache:
            obj = self.cache.pop(key)
            self.cache[key] = obj
            return obj
        obj = self.cache[key] = self.create(key)
        while len(self.cache) > self.cache_size:
            oldest = next(iter(self.cache))
            self.cleanup(oldest, self.cache.pop(oldest))
        return obj
