"""Settings, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from lexquarry.functions.quality import TierLimits
from lexquarry.operators.search import SearchLimits

def read_dotenv(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file, without quotes around values; comments and other lines are skipped. No file: nothing."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = (line.removeprefix("export ").partition("=") for line in map(str.strip, f) if line and not line.startswith("#"))
        return {name.strip(): value.strip().strip("'\"") for name, sign, value in pairs if sign}


YES = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class EngineConfig:
    corpus: str = "out/corpus"
    index: str = "out/index"
    metric: str = "ip"
    dimension: int = 1024
    embedder: str = "offline"
    model: str = "hashed-words"
    embed_attempts: int = 15
    generator: str = "offline"
    temperature: float = 0.2
    use_vectors: bool = True
    auto_build: bool = False
    embed_batch: int = 40
    history_keep: int = 12
    history_prompt: int = 6
    tiers: TierLimits = field(default_factory=TierLimits)
    search: SearchLimits = field(default_factory=SearchLimits)

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None, prefix: str = "LEXQUARRY_") -> EngineConfig:
        """Each plain field from PREFIX + its name in capitals, limits from TIERS_ and SEARCH_ before theirs; empty values
        keep the default. Without a mapping: the process's variables, and below them those of a .env file."""
        environ = read_dotenv() | os.environ if environ is None else environ

        def read(kind, start: str):
            base, found = kind(), {}
            for f in fields(kind):
                raw, old = environ.get(f"{start}{f.name.upper()}", ""), getattr(base, f.name)
                if raw and isinstance(old, bool):
                    found[f.name] = raw.strip().lower() in YES
                elif raw and isinstance(old, (int, float, str)):
                    found[f.name] = type(old)(raw)
            return replace(base, **found)

        return replace(read(cls, prefix), tiers=read(TierLimits, f"{prefix}TIERS_"), search=read(SearchLimits, f"{prefix}SEARCH_"))
