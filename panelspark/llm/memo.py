"""A bounded memory of results that keeps what recurs, and freed memory given back."""

import ctypes

import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only


def give_back() -> None:
    """Return freed memory to the system. A Python worker that Spark reuses otherwise keeps what all its earlier tasks needed."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Memo:
    """Two generations: when the younger is full it becomes the older, and what is asked for again comes back."""

    def __init__(self, size: int, longest_key: int = 64):
        self.young, self.old = {}, {}
        self.size, self.longest = size, longest_key

    def recall(self, key: str):
        """What the older generation has, moved to the younger; else None."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value) -> None:
        if len(key) <= self.longest:
            if len(self.young) >= self.size:
                # the dictionary stays the same object, so that callers may hold on to it
                self.old = dict(self.young)
                self.young.clear()
            self.young[key] = value
