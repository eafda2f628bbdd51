"""What a Python worker remembers between batches, bounded in bytes over all operators.

Spark keeps its Python workers, so what one operator remembers would lie beside what the next
one does. Here a worker holds the memory of one operator at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

#: Bytes that the entries of one memory may take. An entry counts as its key, its value and ENTRY.
CACHED_BYTES = 32 << 20
#: Bytes of a dictionary's place and of the heads of the two objects in it, about.
ENTRY = 200

_HELD: dict[Hashable, Any] = {}


def remembered(name: Hashable, make: Callable[[], Any]) -> Any:
    """The memory of this name, made at its first use; that of any other name is dropped then."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]
