"""Configuration objects and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Metric(str, Enum):
    """Distances; smaller is closer for all of them."""

    L2 = "l2"  # squared
    DOT = "dot"  # negated inner product
    COSINE = "cosine"  # 1 - cosine similarity


class IndexKind(str, Enum):
    FLAT = "flat"  # exact scan
    IVF = "ivf"  # cells around centroids, probed nearest first


class SyncPolicy(str, Enum):
    """When appended operations become durable."""

    ALWAYS = "always"  # a commit per append
    GROUP = "group"  # a commit per flush, or when the buffer is full
    OFF = "off"  # buffered; flush does nothing, close commits


@dataclass(frozen=True)
class AnnParams:
    """Cells (0: the square root of the rows), how many rows to scan per wanted result, seed.

    ``ef`` is the least breadth of a search: the nearest cells are probed until they hold ``factor *
    max(ef, k)`` rows that pass the filter, and the share of them that the recall ``recall`` takes.
    """

    cells: int = 0
    ef: int = 64
    factor: int = 4
    seed: int = 42
    iterations: int = 12
    recall: float = 0.95


@dataclass(frozen=True)
class Persistence:
    """Folder of a durable collection, and its sync policy."""

    path: str
    sync: SyncPolicy = SyncPolicy.ALWAYS
    buffer: int = 1000  # operations that are held back at most


@dataclass(frozen=True)
class CollectionConfig:
    dim: int
    metric: Metric = Metric.COSINE
    index: IndexKind = IndexKind.FLAT
    ann: AnnParams = field(default_factory=AnnParams)
    persistence: Persistence | None = None

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError("dim must be positive")


@dataclass(frozen=True)
class ChunkConfig:
    """Token windows: a window of 0 is one of 1, an overlap not below the window is window - 1."""

    window: int = 64
    overlap: int = 16

    @property
    def effective(self) -> tuple[int, int]:
        window = max(1, self.window)
        return window, min(max(0, self.overlap), window - 1)


@dataclass(frozen=True)
class RagConfig:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    metric: Metric = Metric.COSINE
    index: IndexKind = IndexKind.FLAT
    ann: AnnParams = field(default_factory=AnnParams)
    embed_dim: int = 128
    retrieve_k: int = 5
    token_budget: int = 512
