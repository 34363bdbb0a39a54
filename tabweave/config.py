"""Settings of the engine; every field has the value that the engine is meant to run with."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The English stop words of the corpus' tokens.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


@dataclass(frozen=True)
class IndexConfig:
    stop_words: tuple[str, ...] = tuple(STOP_WORDS)
    stemmer: str | None = None
    min_word_len: int = 1


@dataclass(frozen=True)
class SearchConfig:
    tau: int = 2
    table_limit: int | None = 1000


@dataclass(frozen=True)
class ScoreConfig:
    epsilon: float = 0.01
    alpha: float = 0.99
    table_prior: float = 0.5
    topk: int = 1
    max_requery_iterations: int = 0
    max_requery_answers: int = 50
    #: None: until scores settle, or a state returns.
    max_iterations: int | None = None
    use_majority_voting: bool = False
    use_fuzzy_matching: bool = False
    fuzzy_scorer: str = "max3"
    #: Similarities are between 0 and 1 throughout.
    fuzzy_threshold: float = 0.95
    #: Support edges up to which one task iterates over an exercise; beyond, every iteration is a distributed plan.
    kernel_edges: int = 2_000_000
    seed: int = 2

    def __post_init__(self):
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must be between 0 and 1")


@dataclass(frozen=True)
class HopConfig:
    max_path_len: int = 3
    max_tables: int = 25
    tables_factor: int = 2
    error_threshold_for_fd: float = 0.05
    fd_threshold: float = 0.95
    #: Greatest shares of numeric, null, null or blank, and short values in a column that a path may follow.
    metric_precision: float = 0.1
    none_precision: float = 0.1
    short_precision: float = 0.1
    min_word_len: int = 2
    overlap_threshold: float = 0.5
    max_paths_to_keep: int = 20
    threshold_for_numeric_cols: float = 0.5


@dataclass(frozen=True)
class EngineConfig:
    index: IndexConfig = field(default_factory=IndexConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)
    hop: HopConfig = field(default_factory=HopConfig)
    use_multi_hop: bool = False
