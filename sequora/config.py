"""Parameters of jobs, from Python or from a command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class SweepParameters:
    """A grid of seeds, delays and numbers of clusters, and how many consecutive rows of each group a cell takes."""

    seeds: tuple[int, ...] = (0,)
    delays: tuple[int, ...] = (1,)
    clusters: tuple[int, ...] = (5,)
    rows: int = 100
    rounds: int = 10
    least_rows: int = 200

    @classmethod
    def from_args(cls, args: list[str]) -> SweepParameters:
        """``--seeds 0 1 --rows 50``: what is not given keeps its default."""
        parser = argparse.ArgumentParser(cls.__doc__)
        for f in fields(cls):
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=int, nargs="+" if isinstance(f.default, tuple) else None, default=f.default)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in vars(parser.parse_args(args)).items()})
