"""Breadth-first walks over what is read one by one: index files, pages of a crawl."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

T = TypeVar("T")


def walk(starts: Iterable[str], read: Callable[[str], tuple[T | None, Iterable[str]]], most: float = float("inf"), held: float = float("inf"), counts: Callable[[T], bool] = lambda x: True) -> Iterator[T]:
    """What `read` gives for each address, nearest first, each address once.

    `read(address)` gives a result, or None, and the addresses to go on to. Ends
    after `most` results that count (the others are not given out); what waits
    and what was given stay below `held` together.
    """
    waiting = deque(starts)
    queued, given = set(waiting), 0
    while waiting and given < most:
        result, onward = read(waiting.popleft())
        if result is not None and counts(result):
            given += 1
            yield result
        for address in onward:
            if address not in queued and len(waiting) + given < held:
                queued.add(address)
                waiting.append(address)
