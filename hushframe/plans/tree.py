"""Steps through query trees, parsed or resolved: nodes are dataclasses, and their children stand in fields or tuples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields, is_dataclass, replace
from typing import Any


def _mapped(value: Any, f: Callable) -> Any:
    if isinstance(value, tuple):
        return tuple(_mapped(x, f) for x in value)
    return f(value) if is_dataclass(value) else value


def map_children(node: Any, f: Callable) -> Any:
    """The node with ``f`` of each child in its place; ``f`` may call this again to go deeper."""
    return replace(node, **{x.name: _mapped(getattr(node, x.name), f) for x in fields(node)})


def children(node: Any) -> list:
    found: list = []
    map_children(node, lambda x: found.append(x) or x)
    return found


def walk(node: Any, into: Callable[[Any], bool] = lambda node: True) -> Iterator[Any]:
    """The node and all below it, parents first; below a node only if ``into`` holds for it."""
    yield node
    if into(node):
        for child in children(node):
            yield from walk(child, into)


def rewrite(node: Any, f: Callable) -> Any:
    """``f`` of each node, children first."""
    return f(map_children(node, lambda x: rewrite(x, f)))
