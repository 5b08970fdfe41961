"""Settings of the corpus, the windows and the model, checked in one go on the driver."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class CorpusSettings:
    min_doc_chars: int = 200
    min_mark_ratio: float = 0.05
    max_documents: int = 0
    """At most this many usable documents; 0 keeps all."""
    valid_every: int = 50
    lines_every: int = 4
    web_every: int = 4


@dataclass(frozen=True)
class WindowSettings:
    vocab_size: int = 256
    window: int = 256
    overlap: int = 32

    @property
    def stride(self) -> int:
        return self.window - self.overlap


@dataclass(frozen=True)
class ModelSettings:
    threshold: float = 0.5
    corrections_repeat: int = 90
    context_sizes: tuple[int, ...] = (6, 4, 2, 0)
    min_support: int = 2
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    corpus: CorpusSettings = field(default_factory=CorpusSettings)
    windows: WindowSettings = field(default_factory=WindowSettings)
    model: ModelSettings = field(default_factory=ModelSettings)

    def __post_init__(self) -> None:
        c, w, m = self.corpus, self.windows, self.model
        checks = [
            (w.vocab_size <= 256, "vocab_size is at most 256"),
            (w.vocab_size > 2, "vocab_size is more than 2"),
            (0 <= w.overlap < w.window, "overlap is at least 0 and less than window"),
            (c.valid_every >= 2, "valid_every is at least 2"),
            (min(c.lines_every, c.web_every) >= 1, "lines_every and web_every are at least 1"),
            (c.max_documents >= 0, "max_documents is not negative"),
            (0 <= c.min_mark_ratio <= 1, "min_mark_ratio is a share between 0 and 1"),
            (0 <= m.threshold <= 1, "threshold is a share between 0 and 1"),
            (m.corrections_repeat >= 0, "corrections_repeat is not negative"),
            (m.min_support >= 1, "min_support is at least 1"),
            (
                len(m.context_sizes) > 0
                and list(m.context_sizes) == sorted(set(m.context_sizes), reverse=True)
                and m.context_sizes[-1] >= 0,
                "context_sizes are distinct, descending and not negative",
            ),
        ]
        problems = [message for ok, message in checks if not ok]
        if problems:
            raise ValueError("these settings do not work: " + "; ".join(problems))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **overrides: Any) -> Settings:
        """Settings from upper-case environment names; keyword overrides win."""
        env = os.environ if env is None else env
        known = set()

        def part(kind: type) -> Any:
            values: dict[str, Any] = {}
            for f in dataclasses.fields(kind):
                known.add(f.name)
                default = f.default
                if f.name in overrides:
                    values[f.name] = overrides[f.name]
                elif f.name.upper() in env and isinstance(default, (int, float)):
                    raw = env[f.name.upper()]
                    try:
                        values[f.name] = type(default)(raw)
                    except ValueError as err:
                        raise ValueError(f"{f.name.upper()}={raw!r} is not a number") from err
            return kind(**values)

        settings = cls(part(CorpusSettings), part(WindowSettings), part(ModelSettings))
        unknown = set(overrides) - known
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return settings

    def stamp(self, source: str = "") -> str:
        """What the dataset is made from and how: the corpus and all settings that enter it."""
        parts = {**dataclasses.asdict(self.corpus), **dataclasses.asdict(self.windows)}
        return json.dumps({**parts, "source": source}, sort_keys=True)
