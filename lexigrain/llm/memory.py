"""What a Python worker remembers from task to task, under a bound in bytes."""

from __future__ import annotations

OVERHEAD = 160  # bytes of a dictionary entry and the headers of its key and value


class Generations:
    """Values by key in two generations; keys met again outlive the older one.

    The generations together take about ``limit`` bytes between calls, so a worker that
    stays for many tasks neither grows nor starts cold.
    """

    def __init__(self, limit: int = 48 << 20):
        self.half = limit // 2
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0

    def missing(self, keys: set) -> list:
        """The keys without a value; the values of all others are in ``young``."""
        if self.size > 2 * self.half:  # one huge key or value
            self.young, self.old, self.size = {}, {}, 0
        elif self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0
        old, out = self.old, []
        for key in keys.difference(self.young):
            if key in old:
                self.put(key, old[key])
            else:
                out.append(key)
        return out

    def put(self, key, value: bytes) -> None:
        self.young[key] = value
        self.size += len(key) + len(value) + OVERHEAD

    def put_all(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.size += sum(map(len, keys)) + sum(map(len, values)) + OVERHEAD * len(keys)
