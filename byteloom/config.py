"""Settings of training and ingest, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from byteloom import layout

MODES = ("none", "ascii", "unicode", "null")


@dataclass(frozen=True)
class Segmentation:
    """How sequences are cut. probability is the chance that a delimiter run cuts; 0 leaves sequences whole."""

    mode: str = "none"
    probability: float = 1.0
    seed: int = 0

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown segmentation mode {self.mode!r}")
        if not 0.0 <= self.probability <= 1.0:
            raise ValueError("the split probability lies in [0, 1]")

    @property
    def enabled(self) -> bool:
        return self.mode != "none" and self.probability > 0


@dataclass(frozen=True)
class TrainerConfig:
    """Settings of a training run; allowed_lengths defaults to 1-32 bytes, to 1-16 where white space cuts."""

    vocab_size: int = 32_768
    min_frequency: int = 4
    allowed_lengths: tuple[int, ...] | None = None
    segmentation: Segmentation = field(default_factory=Segmentation)
    custom_specials: tuple[str, ...] = ()
    reasoning: bool = True
    max_iterations: int | None = None
    plateau: bool = False
    plateau_floor: int = 128
    plateau_patience: int = 32
    plateau_divisor: int = 512
    require_letter: bool = False
    forbid_leading_space: bool = False

    def __post_init__(self) -> None:
        given = self.allowed_lengths
        if given is None:
            given = range(1, 17 if self.segmentation.mode in ("ascii", "unicode") else 33)
        object.__setattr__(self, "allowed_lengths", tuple(sorted(set(given))))
        object.__setattr__(self, "custom_specials", tuple(dict.fromkeys(self.custom_specials)))
        if 1 not in self.allowed_lengths:
            raise ValueError("allowed lengths include 1")
        if self.min_frequency < 1:
            raise ValueError("min_frequency is 1 at least")
        if self.plateau_divisor < 1 or (self.plateau and self.plateau_patience < 1):
            raise ValueError("plateau divisor and patience are 1 at least")
        clash = set(self.custom_specials) & {*layout.LEADING, *layout.REASONING}
        if clash or "" in self.custom_specials:
            raise ValueError(f"custom specials clash with built-in tokens or are empty: {sorted(clash)}")
        if not self.base_size <= self.vocab_size < 2**31:
            raise ValueError(f"the vocabulary holds {self.base_size} tokens at least")

    @property
    def trailing(self) -> tuple[str, ...]:
        return (layout.REASONING if self.reasoning else ()) + self.custom_specials

    @property
    def base_size(self) -> int:
        return layout.FIRST_TRAILING + len(self.trailing)

    @property
    def merge_budget(self) -> int:
        return self.vocab_size - self.base_size

    def with_(self, **changes: object) -> TrainerConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class Ingest:
    """How files become sequences. chunk_size 0 keeps a file whole."""

    chunk_size: int = 8192
    recursive: bool = True
    follow_symlinks: bool = False

    def __post_init__(self) -> None:
        if self.chunk_size < 0:
            raise ValueError("chunk_size isn't negative")
