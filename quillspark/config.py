"""Settings of the curation operators; every default is stated once, here."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class CleaningConfig:
    """Which cleaning detectors run; none by default."""

    blank_line_compression: bool = False
    leading_fullwidth_space: bool = False
    inline_fullwidth_space: bool = False
    control_char: bool = False
    trailing_whitespace: bool = False

    @classmethod
    def everything(cls) -> CleaningConfig:
        """All detectors on."""
        return cls(*[True] * len(fields(cls)))


@dataclass(frozen=True)
class WatermarkConfig:
    """Weights and thresholds of boilerplate scoring."""

    auto_threshold: float = 0.70
    suspect_threshold: float = 0.42
    weight_repeat: float = 0.40
    weight_non_cjk: float = 0.20
    weight_keyword: float = 0.40
    repeat_count_min: int = 5
    min_line_chars: int = 10
    enabled: bool = True


@dataclass(frozen=True)
class ChapterConfig:
    """Limits of heading detection and of the splitting of oversized chapters."""

    heading_chars: int = 100
    structural_chars: int = 30
    oversize_factor: float = 2.5
    preface_title: str = "楔子"
    volume_preface_title: str = "(卷前)"


def partial_config(base, values: dict):
    """A config from a partial dict: missing fields keep their defaults, unknown ones raise."""
    unknown = set(values) - {f.name for f in fields(base)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(base, **values)
