"""What a Python worker keeps between tasks.

Workers live on from task to task, and so from one query or stage of a pipeline to the next. The tables that an operator has made are worth
keeping for its own tasks, but not beside what the next operator needs: only those of the operator that ran last stay.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

_last: tuple[str, tuple[Callable[[], None], ...]] = ("", ())


def turn(operator: str, *drops: Callable[[], None]) -> None:
    """Called where an operator's task begins. What the worker keeps of another operator is dropped; drops: how to drop what this one will keep."""
    global _last
    name, others = _last
    if name != operator:
        for drop in others:
            drop()
        pa.default_memory_pool().release_unused()
    _last = (operator, drops)
