"""Defaults of a run, set where they aren't given.  Cores and memory belong to Spark's own configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    corpus: str = ""
    text_col: str = "text"
    ngram: int = 5
    threshold: float = 0.8
    seeds: int = 100
    bands: int = 20
    quantile: float = 0.8
    truncation: int = 1024
    sample_size: int = 10_000
    seed: int = 0

    def having(self, **given) -> Settings:
        """These settings with the given ones that aren't None."""
        unknown = set(given) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: v for k, v in given.items() if v is not None})
