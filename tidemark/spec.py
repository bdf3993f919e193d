"""What a series is made of and which features are wanted."""

from __future__ import annotations

from dataclasses import dataclass

ENGINES = ("kernels", "canonical", "wavelets", "statistics", "signatures")


class ValidationError(ValueError):
    """The input cannot be processed as asked."""


@dataclass(frozen=True)
class SeriesSpec:
    """Roles of columns.  ``tiebreak`` orders rows of equal time; without it, (entity, time) should be unique."""

    entity: str = "symbol"
    time: str = "date"
    channels: tuple[str, ...] = ("close",)
    signature_channels: tuple[str, ...] = ("close", "volume")
    tiebreak: tuple[str, ...] = ()

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tiebreak)

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.channels, *self.signature_channels)))


@dataclass(frozen=True)
class FeatureConfig:
    """Window length, engines and their parameters; ``families`` limits the statistical bank to some of its families."""

    window: int = 20
    engines: tuple[str, ...] = ENGINES
    kernels: int = 250
    seed: int = 42
    wide: bool = True
    depth: int = 3
    wavelets: tuple[str, ...] = ("haar", "db4")
    levels: int = 4
    coefficients: int = 50
    lags: tuple[int, ...] | None = None
    time_augment: bool = True
    leadlag: bool = False
    normalize: bool = True
    min_extra: int = 5
    families: tuple[str, ...] = ()

    def __post_init__(self):
        if self.window < 2:
            raise ValidationError("a window needs at least two rows")
        if unknown := set(self.engines) - set(ENGINES):
            raise ValidationError(f"unknown engines: {', '.join(sorted(unknown))}")
