"""T-occurrence search with DivideSkip.

Given a query's elements and, for each, the ascending list of documents that
have it, find the documents on at least T lists.  The longest lists are put
aside; the short ones are merged with a heap, where a document needs only T less
the number of long lists; each that has them is looked for in the long lists by
binary search, and dropped as soon as it can no longer reach T.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np

#: Weight of list length against threshold in choosing how many lists are long.
MU = 0.01


def inverted_lists(query: np.ndarray, sets: list[np.ndarray]) -> list[list[int]]:
    """Documents by element of the query, for elements that any of them has."""
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    order = np.lexsort((doc[hit], at[hit]))
    at, doc = at[hit][order], doc[hit][order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    return [x.tolist() for x in np.split(doc, cuts)] if len(doc) else []


def divide_skip(lists: list[list[int]], need: list[int]) -> dict[int, int]:
    """Documents on at least ``need[document]`` (1 or more) of the lists, and on how many."""
    if not lists:
        return {}
    least = min(need)
    lists = sorted(lists, key=len)
    n_long = min(max(0, least - 1), len(lists), int(least / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while heap:
        document, count = heap[0][0], 0
        while heap and heap[0][0] == document:
            _, k, i = heap[0]
            count += 1
            if i + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][i + 1], k, i + 1))
            else:
                heapq.heappop(heap)
        if count + n_long >= need[document]:
            left = n_long
            for x in long:
                i = bisect_left(x, document)
                count += i < len(x) and x[i] == document
                left -= 1
                if count + left < need[document]:
                    break
            if count >= need[document]:
                found[document] = count
    return found


def search(query: np.ndarray, sets: list[np.ndarray], need: list[int]) -> dict[int, int]:
    """Which of some sets share at least ``need`` elements with the query's."""
    return divide_skip(inverted_lists(query, sets), need) if sets and len(query) else {}
