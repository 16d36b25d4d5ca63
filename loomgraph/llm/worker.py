"""What tasks keep in a Python worker, which Spark uses again for later tasks and jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc

_held: dict[str, Any] = {}


def hold(key: str, make: Callable[[], Any]) -> Any:
    """The worker's object of this name, made where missing. A worker holds one at a time, so that what one
    operator has gathered doesn't stay beside what the next one needs."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what earlier tasks have left."""
    _held.clear()


def parts(column: pa.Array, size: int) -> Iterator[slice]:
    """Row ranges of a text column of about ``size`` bytes each, at least a row."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    a, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total > size or i == len(lengths) - 1:
            yield slice(a, i + 1)
            a, total = i + 1, 0
