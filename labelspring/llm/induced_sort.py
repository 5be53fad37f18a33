"""External induced suffix sorting with common-prefix values.

``sorted_suffixes(text)`` yields (position, lcp with the suffix before) in order.  The
text is a sequence of integers; ``join`` builds one from byte strings with an own
smallest end mark for each, so no common prefix passes an end.

Recursion: the substrings between left-most S positions are sorted and named; if two
names are equal, the string of names is sorted the same way, and its common prefixes
become those of the text.  Induction: a priority queue of (character, place of the
next suffix, position, common prefix) gives the L suffixes in ascending order, a second one the S
suffixes in descending order.  The common prefix of two neighbours with one first
character is one more than the least value between their next suffixes; those
minima come from a stack of the values passed so far.

Queues spill sorted runs to files of the task's temporary folder beyond ``HELD``
entries, so a shard may be far larger than the memory for Python objects.  The
files go when the queue is done.
"""

from __future__ import annotations

import bisect
import heapq
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np

HELD = 200_000  # entries of a queue in memory
CHUNK = 4096  # entries read from a run at once


class SpillQueue:
    """Smallest entry first.  Entries pushed are never smaller than the last one popped."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs = held, [], []

    def push(self, entry: tuple) -> None:
        if len(self.heap) >= self.held:
            self.heap.sort()
            file = tempfile.TemporaryFile()
            for i in range(0, len(self.heap), CHUNK):
                pickle.dump(self.heap[i : i + CHUNK], file)
            file.seek(0)
            run = self._entries(file)
            self.heap = []
            heapq.heappush(self.runs, (next(run), len(self.runs), run))
        heapq.heappush(self.heap, entry)

    @staticmethod
    def _entries(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def peek(self):
        head = self.heap[0] if self.heap else None
        if self.runs and (head is None or self.runs[0][0] < head):
            return self.runs[0][0]
        return head

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, n, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, n, run))
            return entry
        return heapq.heappop(self.heap)


class Minima:
    """Least value after a place, over values passed so far."""

    def __init__(self):
        self.places: list[int] = []
        self.values: list[int] = []

    def add(self, place: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.places.pop()
        self.places.append(place)
        self.values.append(value)

    def after(self, place: int) -> int:
        return self.values[bisect.bisect_right(self.places, place)]


def join(strings: list) -> tuple[np.ndarray, np.ndarray]:
    """The text of all strings (bytes or arrays of numbers from 0), each with its own end mark, and where each begins."""
    k = len(strings)
    starts = np.cumsum([0] + [len(s) + 1 for s in strings])
    text = np.empty(starts[-1], np.int64)
    for i, s in enumerate(strings):
        text[starts[i] : starts[i + 1] - 1] = k + (np.frombuffer(s, np.uint8).astype(np.int64) if isinstance(s, bytes) else s)
        text[starts[i + 1] - 1] = k - 1 - i  # the last one is the smallest of all
    return text, starts[:-1]


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a suffix is of type S, and the length of the run of its first character."""
    n = len(text)
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # ends of runs
    end = last[np.searchsorted(last, np.arange(n))]
    rising = np.zeros(n, bool)
    inner = end < n - 1
    rising[inner] = text[end[inner] + 1] > text[end[inner]]
    rising[-1] = True
    return rising, end - np.arange(n) + 1


def _lms_order(text: list[int], typed: list[int], lms: list[int], held: int) -> Iterator[tuple[int, int]]:
    """(position, lcp) of the left-most S suffixes in order; ``typed`` ranks L before S of one character."""
    m = len(lms)
    queue = SpillQueue(held)
    for i in range(m):
        end = lms[i + 1] + 1 if i + 1 < m else len(text)
        queue.push((typed[lms[i] : end], i))
    names, name, before = array("q", bytes(8 * m)), -1, None
    order = array("q")
    while queue.peek() is not None:
        part, i = queue.pop()
        if part != before:
            name, before = name + 1, part
        names[i] = name
        order.append(i)
    if name + 1 == m:
        ranked: Iterator[tuple[int, int]] = ((i, 0) for i in order)
    else:
        ranked = sorted_suffixes(np.array(names, np.int64), held)
    previous = -1
    for i, common in ranked:
        if previous < 0:
            lcp = 0
        else:
            # the names in common, then the first part that differs
            a, b = lms[i + common], lms[previous + common]
            while a < len(text) and b < len(text) and text[a] == text[b]:
                a, b = a + 1, b + 1
            lcp = a - lms[i]
        yield lms[i], lcp
        previous = i


def sorted_suffixes(numbers: np.ndarray, held: int = HELD) -> Iterator[tuple[int, int]]:
    """(position, lcp) of all suffixes in ascending order; the last number must be the only smallest."""
    n = len(numbers)
    if n < 2:
        yield from ((i, 0) for i in range(n))
        return
    rising, run = _types(numbers)
    text = numbers.tolist()
    typed = (2 * numbers + rising).tolist()
    starts = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    lms = starts.tolist()
    is_s, run = rising.tolist(), run.tolist()

    # L suffixes, ascending
    large, large_lcp = array("q"), array("q")
    queue, minima, place = SpillQueue(held), Minima(), 0
    pushed: dict[int, int] = {}  # place of the last suffix that induced one with this character
    bucket = last = -1

    def passed(at: int, lcp: int) -> None:
        nonlocal place
        minima.add(place, lcp)
        if at and not is_s[at - 1]:
            c = text[at - 1]
            queue.push((c, place, at - 1, 1 + minima.after(pushed[c]) if c in pushed else 0))
            pushed[c] = place
        place += 1

    seeds = _lms_order(text, typed, lms, held)
    seed = next(seeds, None)
    fresh = True  # the next seed is the first of its bucket after other suffixes
    while seed is not None or queue.peek() is not None:
        head = queue.peek()
        if head is not None and (seed is None or head[0] <= text[seed[0]]):
            c, _, at, lcp = queue.pop()
            bucket, last, fresh = c, at, True
            large.append(at)
            large_lcp.append(lcp)
            passed(at, lcp)
        else:
            at, lcp = seed
            c = text[at]
            if c != bucket:
                lcp = 0
            elif fresh:
                lcp = min(run[at], run[last])
            bucket, last, fresh = c, at, False
            passed(at, lcp)
            seed = next(seeds, None)

    # all suffixes, descending; lcp is with the one before in this order, the larger one
    queue, minima, place, bucket, last = SpillQueue(held), Minima(), 0, -1, -1
    pushed = {}
    out, out_lcp = array("q"), array("q")

    def taken(at: int, lcp: int) -> None:
        nonlocal place
        minima.add(place, lcp)
        out.append(at)
        out_lcp.append(lcp)
        if at and is_s[at - 1]:
            c = -text[at - 1]
            queue.push((c, place, at - 1, 1 + minima.after(pushed[c]) if c in pushed else 0))
            pushed[c] = place
        place += 1

    i = len(large) - 1
    above_lcp = 0  # lcp of the L taken last with the L below it
    fresh = True
    while i >= 0 or queue.peek() is not None:
        head = queue.peek()
        if head is not None and (i < 0 or -head[0] >= text[large[i]]):
            c, _, at, lcp = queue.pop()
            bucket, last, fresh = -c, at, True
            taken(at, lcp)
        else:
            at = large[i]
            c = text[at]
            lcp = 0 if c != bucket else min(run[at], run[last]) if fresh else above_lcp
            above_lcp = large_lcp[i]
            bucket, last, fresh = c, at, False
            taken(at, lcp)
            i -= 1
    # the end mark follows no larger suffix that could induce it
    if not len(out) or out[-1] != n - 1:
        out.append(n - 1)
        out_lcp.append(0)
    lcp = 0
    for i in range(len(out) - 1, -1, -1):
        yield out[i], lcp
        lcp = out_lcp[i]
