"""Run parameters shared by the batch and streaming jobs."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

# The defaults and the method names users already rely on.
METHODS = ("exact", "minhash", "bloomfilter", "minhash_bloom_hybrid")
DEFAULT_SPLIT = "train"
DEFAULT_TEXT = "text"
DEFAULT_CHUNK_SIZE = 1000
DEFAULT_THRESHOLD = 0.8
DEFAULT_NUM_HASHES = 150
DEFAULT_NGRAM = 2
DEFAULT_NUM_PERM = 128
DEFAULT_TOP_N = 10
PAIRS_PER_CHUNK = 10
SAMPLE_CHARS = 200
HISTOGRAM_BINS = 20

BLOOM_METHODS = ("bloomfilter", "minhash_bloom_hybrid")


@dataclass(frozen=True)
class Params:
    """Settings of one de-duplication run.

    ``order_column`` holds the position of a row in the corpus: a unique,
    non-negative BIGINT.  The row with the lowest position survives.
    ``hot_rows`` is the number of rows of one key a single task is asked to
    join; keys with more rows are spread over several tasks.  ``plain_rounds``
    is how many rounds first-come selection takes before it turns to whole
    components.  ``min_tasks`` is for corpora that lie in a few large row groups:
    a scan with fewer splits than that is shuffled once, and one with as many or
    more is left as it is.

    ``dataset_name`` is where ``run`` reads when it is given no source.  Rows are
    selected by ``dataset_config`` and ``dataset_split`` only where
    ``config_column`` and ``split_column`` name the columns that hold them.
    """

    dataset_name: str | None = None
    dataset_config: str | None = None
    dataset_split: str = DEFAULT_SPLIT
    config_column: str | None = None
    split_column: str | None = None
    text_column: str = DEFAULT_TEXT
    order_column: str = "doc_id"
    key: str | None = None
    method: str = "exact"
    chunk_size: int = DEFAULT_CHUNK_SIZE
    max_chunks: int | None = None
    minhash_threshold: float = DEFAULT_THRESHOLD
    minhash_num_hashes: int = DEFAULT_NUM_HASHES
    minhash_ngram_size: int = DEFAULT_NGRAM
    minhash_num_perm: int = DEFAULT_NUM_PERM
    bloom_error_rate: float | None = None
    bloom_capacity: int | None = None
    log_duplicates: bool = True
    top_n_duplicates: int = DEFAULT_TOP_N
    hot_rows: int = 1_000_000
    plain_rounds: int = 6
    min_tasks: int | None = None

    def __post_init__(self) -> None:
        positive = (
            "chunk_size", "minhash_num_hashes", "minhash_ngram_size",
            "minhash_num_perm", "top_n_duplicates", "hot_rows", "plain_rounds",
        )
        for name in positive:
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1, got {getattr(self, name)}")
        if self.max_chunks is not None and self.max_chunks < 1:
            raise ValueError(f"max_chunks must be None or at least 1, got {self.max_chunks}")
        if not 0.0 < self.minhash_threshold < 1.0:
            raise ValueError(f"minhash_threshold must lie in (0, 1), got {self.minhash_threshold}")
        if self.bloom_error_rate is not None and not 0.0 < self.bloom_error_rate < 1.0:
            raise ValueError(f"bloom_error_rate must lie in (0, 1), got {self.bloom_error_rate}")
        if self.bloom_capacity is not None and self.bloom_capacity < 1:
            raise ValueError(f"bloom_capacity must be at least 1, got {self.bloom_capacity}")
        if self.key is not None and self.method in ("exact", "minhash"):
            raise ValueError(f"method {self.method!r} compares texts and takes no key")
        if self.config_column is not None and self.dataset_config is None:
            raise ValueError("config_column needs a dataset_config")
        if self.method in BLOOM_METHODS and not self.has_bloom:
            raise ValueError(f"method {self.method!r} needs bloom_capacity and bloom_error_rate")

    @property
    def has_bloom(self) -> bool:
        return self.bloom_capacity is not None and self.bloom_error_rate is not None

    def bloom(self) -> "BloomShape":
        if not self.has_bloom:
            raise ValueError("bloom_capacity and bloom_error_rate are required")
        return BloomShape.sized(self.bloom_capacity, self.bloom_error_rate)

    def bands(self) -> "BandShape":
        return BandShape.chosen(self.minhash_threshold, self.minhash_num_hashes)

    def but(self, **changes) -> "Params":
        return replace(self, **changes)


@dataclass(frozen=True)
class BloomShape:
    """Bits ``m`` and hash count ``k`` of a Bloom filter."""

    m: int
    k: int

    @staticmethod
    def sized(capacity: int, error_rate: float) -> "BloomShape":
        bits = int(-capacity * math.log(error_rate) / math.log(2) ** 2)
        hashes = int(bits / capacity * math.log(2))
        if bits < 1 or hashes < 1:
            raise ValueError(
                f"a filter for {capacity} rows at error rate {error_rate} would have "
                f"{bits} bits and {hashes} hashes; lower bloom_error_rate"
            )
        return BloomShape(bits, hashes)


@dataclass(frozen=True)
class BandShape:
    """``bands`` groups of ``rows`` signature values."""

    bands: int
    rows: int

    @property
    def used(self) -> int:
        return self.bands * self.rows

    def match_probability(self, similarity: float) -> float:
        """Chance that two rows of this similarity share at least one band."""
        return 1.0 - (1.0 - similarity ** self.rows) ** self.bands

    @staticmethod
    def chosen(threshold: float, num_hashes: int, steps: int = 1000) -> "BandShape":
        """Shape with the least mean area of wrong matches and missed matches."""
        import numpy as np

        if num_hashes == 1:
            return BandShape(1, 1)
        below = (np.arange(steps) + 0.5) * (threshold / steps)
        above = threshold + (np.arange(steps) + 0.5) * ((1.0 - threshold) / steps)
        best = None
        for bands in range(1, num_hashes + 1):
            for rows in range(1, num_hashes // bands + 1):
                wrong = (1.0 - (1.0 - below ** rows) ** bands).mean() * threshold
                missed = ((1.0 - above ** rows) ** bands).mean() * (1.0 - threshold)
                cost = 0.5 * wrong + 0.5 * missed
                if best is None or cost < best[0]:
                    best = (cost, bands, rows)
        return BandShape(best[1], best[2])
