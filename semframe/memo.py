"""Remembered results that travel without their memory."""

from __future__ import annotations

from collections.abc import Callable


class memo:  # noqa: N801 - a decorator
    """Keeps up to ``most`` results of a function, then starts anew.

    Unlike the standard library's cache it is sent to workers by value, and
    empty."""

    def __init__(self, function: Callable, most: int = 200_000):
        self.function, self.most, self.known = function, most, {}

    def __call__(self, *args):
        try:
            return self.known[args]
        except KeyError:
            if len(self.known) >= self.most:
                self.known.clear()
            out = self.known[args] = self.function(*args)
            return out

    def __getstate__(self):
        return {"function": self.function, "most": self.most, "known": {}}
