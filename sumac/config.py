"""Validated settings of runs, judging and generation."""

from __future__ import annotations

from dataclasses import dataclass, fields


def _within(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in {low}..{high}")


def _flat(text: str) -> dict:
    values = {}
    for line in text.splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        if colon and value.strip():
            v = value.strip().strip("'\"")
            values[name.strip()] = {"true": True, "false": False, "null": None}.get(v.lower(), int(v) if v.lstrip("-").isdigit() else float(v) if v.replace(".", "", 1).lstrip("-").isdigit() else v)
    return values


class _Config:
    @classmethod
    def read(cls, values: dict):
        """Settings of a mapping; an unknown name is an error."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def load(cls, path: str):
        """Settings of a YAML file; without the yaml package, of a file of `name: value` lines."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml
        except ImportError:  # flat files are read without it
            return cls.read(_flat(text))
        return cls.read(yaml.safe_load(text) or {})


@dataclass(frozen=True)
class RunConfig(_Config):
    name: str
    index: str = "sparse"
    top_k: int = 1000
    top_n: int = 1000
    k1: float = 0.9
    b: float = 0.4
    fusion: str = "rrf"
    rrf_k: int = 60

    def __post_init__(self):
        if self.index not in ("sparse", "dense", "formula", "fused"):
            raise ValueError(f"unknown index {self.index}")
        if self.fusion not in ("rrf", "combsum", "combmnz"):
            raise ValueError(f"unknown fusion {self.fusion}")
        _within("top_k", self.top_k, 1, 100_000)
        _within("top_n", self.top_n, 1, 100_000)
        _within("b", self.b, 0, 1)
        _within("rrf_k", self.rrf_k, 1, 10_000)


@dataclass(frozen=True)
class JudgeConfig(_Config):
    model: str
    chunk: int = 3000
    in_flight: int = 1
    attempts: int = 3

    def __post_init__(self):
        _within("chunk", self.chunk, 1, 3000)
        _within("in_flight", self.in_flight, 1, 1)
        _within("attempts", self.attempts, 1, 10)


@dataclass(frozen=True)
class GenerationConfig(_Config):
    model: str
    contexts: str = "none"
    k: int = 0
    max_new_tokens: int = 512
    seed: int = 42

    def __post_init__(self):
        if self.contexts not in ("none", "run", "reference", "disjoint"):
            raise ValueError(f"unknown context source {self.contexts}")
        if (self.contexts == "none") != (self.k == 0):
            raise ValueError("k goes with a context source")
        _within("max_new_tokens", self.max_new_tokens, 1, 100_000)
