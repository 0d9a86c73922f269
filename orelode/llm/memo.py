"""Results kept by arguments, for functions that travel to the executors by value."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """A function that keeps its results; unlike the cache of the standard library it is pickled whole, without them."""

    def __init__(self, function: Callable):
        self.function, self.kept = function, {}
        self.__doc__ = function.__doc__

    def __call__(self, *key):
        if key not in self.kept:
            self.kept[key] = self.function(*key)
        return self.kept[key]

    def __reduce__(self):
        return Memo, (self.function,)
