"""Counts and durations of what a database does."""

from __future__ import annotations

import bisect
import time
from collections import Counter
from contextlib import contextmanager

from brindle.plans.filters import equalities

#: Upper bounds of a histogram's buckets, in seconds.
BOUNDS = [0.001 * 2**k for k in range(20)]


class Histogram:
    """Counts of durations in buckets that double."""

    def __init__(self) -> None:
        self.counts, self.n, self.total, self.most = [0] * (len(BOUNDS) + 1), 0, 0.0, 0.0

    def add(self, seconds: float) -> None:
        self.counts[bisect.bisect_left(BOUNDS, seconds)] += 1
        self.n, self.total, self.most = self.n + 1, self.total + seconds, max(self.most, seconds)

    def quantile(self, share: float) -> float:
        """The bound of the bucket in which that share of the durations is reached; 0 without any."""
        seen = 0
        for bound, n in zip([*BOUNDS, self.most], self.counts, strict=True):
            seen += n
            if n and seen >= share * self.n:
                return min(bound, self.most)
        return 0.0


class Metrics(Counter):
    """Counters by name: reads, rows_returned, documents_written, point_scans, index_scans,
    collection_scans, files_scanned, files_skipped, sorts; ``seconds`` has a histogram by kind of work."""

    def __init__(self) -> None:
        super().__init__()
        self.seconds: dict[str, Histogram] = {}

    def scanned(self, tree, files: int, of: int) -> None:
        """A scan: by key if the filter fixes the key, by zones if they left files out, else of the collection."""
        point = tree is not None and ("_id",) in equalities(tree)
        self["point_scans" if point else "index_scans" if files < of else "collection_scans"] += 1
        self["files_scanned"] += files
        self["files_skipped"] += of - files

    @contextmanager
    def timed(self, kind: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds.setdefault(kind, Histogram()).add(time.monotonic() - began)
