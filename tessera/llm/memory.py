"""A bounded table of remembered results."""

from __future__ import annotations


class Memory(dict):
    """What ``make`` gives for a key: once the table is full, entries that were not asked for since the last time it
    was full are forgotten. Long keys are not kept."""

    def __init__(self, make, size: int = 300_000):
        super().__init__()
        self.make, self.size, self.before = make, size, {}

    def __missing__(self, key: str):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(key) <= 64:
            if len(self) >= self.size:
                self.before = dict(self)
                self.clear()
            self[key] = value
