"""What a Python worker keeps between tasks: the caches of one operator, and of no other."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_HELD: dict[Hashable, object] = {}


def held(name: Hashable, make: Callable[[], T]) -> T:
    """The state of that name, made on first use; making one lets go of any other, so stages of a pipeline don't add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]
