"""What a handler can reach while its task runs: counters, a status text, and pools that are flushed together."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from millrace.operators.mutations import MutationPool

#: Name of the pool of puts and deletes that every context has.
MUTATIONS = "mutations"


class Pool(Protocol):
    """Anything that gathers work: flush does it, and may give operations for the task to hand on."""

    def flush(self) -> Iterable | None: ...


class Context:
    """The state of one task of a handler; a retried task starts with an empty one, and with smaller pools."""

    _current: Context | None = None

    def __init__(self, shard: int = 0, attempt: int = 0, params: dict | None = None) -> None:
        self.shard, self.attempt, self.params = shard, attempt, dict(params or {})
        self.counters: dict[str, int] = {}
        self.status: str | None = None
        self._out: list = []
        self._pools: dict[str, Pool] = {}
        self.mutations = MutationPool(self._write, retries=attempt)
        self.register(MUTATIONS, self.mutations)

    def _write(self, puts: list, deletes: list) -> None:
        self._out += [*puts, *deletes]

    def increment(self, name: str, delta: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + delta

    def register(self, name: str, pool: Pool) -> None:
        """Have a pool flushed with this context; one of the same name is replaced."""
        self._pools[name] = pool

    def pool(self, name: str) -> Pool | None:
        return self._pools.get(name)

    def flush(self) -> list:
        """Flush all pools; the operations that they give, in the order of their registration."""
        for pool in self._pools.values():
            self._out += pool.flush() or ()
        out, self._out = self._out, []
        return out

    def __enter__(self) -> Context:
        Context._current = self
        return self

    def __exit__(self, *_: object) -> None:
        Context._current = None


def current() -> Context | None:
    """The context of the task that runs in this process; None outside of handlers."""
    return Context._current
