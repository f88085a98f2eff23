"""Settings of the topic engine."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """All constants of matching, clustering and topic life, with their usual values."""

    dim: int = 1024
    alpha: float = 0.66  #: scale of proto-cluster radii and of topic merges
    beta: float = 0.76  #: a document matches a topic below this pair distance
    check: int = 10  #: a proto-cluster with more members becomes a topic
    k: int = 10  #: topics kept for a subscription
    decay: float = 4e-4  #: decay rate of a pivot for each tick
    min_keep: float = 1e-10  #: a pivot expires below this score
    single_distance: bool = False  #: match on twice the nearest pivot instead of the two nearest
    distinct_texts: int = 3  #: a topic with no more distinct texts gets no pivots
    max_pivots: int = 6
    flush_beta: float = 100.0  #: the limit when the rest is assigned at the end of a stream
    retention: int = 100_000  #: documents that the proto-clusters look back
    subscriptions: int = 1_000_000  #: arrivals that count as subscriptions before publishing starts
    publications: int = 2_000_000
    publish_from: int = 1  #: row at which publishing starts again
    ordered: bool = False  #: a batch has the outcome of one document after the other, whatever its size
    no_distance: float = 1e6  #: stands for a distance that does not exist
    #: Pivots that are sent to all executors at once; beyond it both sides are dealt in blocks.
    broadcast_pivots: int = 50_000
    broadcast_bytes: int = 64 << 20  #: the same, for their vectors

    @property
    def first_radius(self) -> float:
        return self.alpha / (math.log(2) + 1)

    @property
    def candidate_limit(self) -> float:
        return 1 - math.cos(self.alpha)
