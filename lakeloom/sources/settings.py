"""Settings of transcript search, from the environment or a file of KEY=value lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


class BadSetting(ValueError):
    """A setting that can't be read or doesn't fit."""


def env_file(path: str) -> dict[str, str]:
    """KEY=value lines; blank lines and those that begin with # are skipped, outer quotes of a value go. A missing file is an empty one."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    pairs = [x.removeprefix("export ").split("=", 1) for x in lines if "=" in x and not x.startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def _number(kind: type, what: str):
    def read(name: str, raw: str):
        try:
            return kind(raw)
        except ValueError as e:
            raise BadSetting(f"{name} must be {what}, not {raw!r}") from e

    return read


#: How a value is read, by the type of the setting's default; all but text have their default for a blank value.
READ = {
    int: _number(int, "an integer"),
    float: _number(float, "a number"),
    tuple: lambda _, raw: tuple(x.strip() for x in raw.split(",") if x.strip()),
}


@dataclass(frozen=True)
class Settings:
    """Each field's variable is its name in capitals."""

    embedding_model: str = "hashing-64"
    chunk_size: int = 800
    chunk_overlap: int = 150
    top_k: int = 4
    temperature: float = 0.2
    max_tokens: int = 512
    preferred_languages: tuple[str, ...] = ("en",)
    target_language: str = "en"
    cache_dir: str = ".cache/indexes"

    def __post_init__(self):
        if self.chunk_size <= 0:
            raise BadSetting("CHUNK_SIZE must be above 0")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise BadSetting("CHUNK_OVERLAP must be from 0 to below CHUNK_SIZE")
        if self.top_k <= 0:
            raise BadSetting("TOP_K must be above 0")

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, file: str = ".env") -> Settings:
        """Settings from env (the process's environment if None), over those of the file, over the defaults."""
        given = env_file(file) | dict(os.environ if env is None else env)
        found = {}
        for f in fields(cls):
            name = f.name.upper()
            raw = given.get(name)
            read = READ.get(type(f.default))
            if raw is None or (read and not raw.strip()):
                continue
            found[f.name] = read(name, raw) if read else raw.strip()
        return cls(**found)

    def fingerprint_parts(self) -> tuple[str, ...]:
        """What an index depends on."""
        return self.embedding_model, str(self.chunk_size), str(self.chunk_overlap), self.target_language, ",".join(self.preferred_languages)
