"""Settings of the engine, their YAML form and validation."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, replace

import yaml

MAX_BLOCK = 64


@dataclass(frozen=True)
class CompressionSettings:
    """How a cloud becomes an occupancy grid and blocks. Immutable: with_() gives a changed copy."""

    voxel_size: float = 0.01
    block_size: int = 8
    min_points: int = 1
    margin: float = 0.0

    def with_(self, **changes) -> CompressionSettings:
        return replace(self, **changes)

    @property
    def threshold(self) -> int:
        return max(1, self.min_points)

    @property
    def pattern_bits(self) -> int:
        return self.block_size**3

    @property
    def pattern_bytes(self) -> int:
        return (self.pattern_bits + 7) // 8


@dataclass(frozen=True)
class CompressorConfig:
    """A `compress` run as a YAML file describes it."""

    input_file: str = ""
    voxel_size: float = 0.01
    block_size: int = 8
    min_points_threshold: int = 1
    publish_occupied_voxel_markers: bool = False
    save_hdf5: bool = False
    hdf5_output_file: str = ""
    save_raw_hdf5: bool = False
    raw_hdf5_output_file: str = ""

    def problems(self, look: bool = True) -> list[str]:
        """Every reason not to run; look: also whether the input exists."""
        found = []
        if not self.input_file:
            found.append("input_file is empty")
        elif look and "://" not in self.input_file and not os.path.exists(self.input_file):
            found.append(f"input_file does not exist: {self.input_file}")
        for bad, said in (
            (self.voxel_size <= 0, "voxel_size must be positive"),
            (self.block_size <= 0, "block_size must be greater than zero"),
            (self.min_points_threshold < 0, "min_points_threshold must be non-negative"),
            (self.save_hdf5 and not self.hdf5_output_file, "hdf5_output_file must be set when save_hdf5 is true"),
            (self.save_raw_hdf5 and not self.raw_hdf5_output_file, "raw_hdf5_output_file must be set when save_raw_hdf5 is true"),
        ):
            if bad:
                found.append(said)
        return found

    @property
    def settings(self) -> CompressionSettings:
        return CompressionSettings(float(self.voxel_size), self.block_size, self.min_points_threshold)

    @property
    def archive_path(self) -> str | None:
        return self.hdf5_output_file if self.save_hdf5 and self.hdf5_output_file else None

    @property
    def raw_path(self) -> str | None:
        return self.raw_hdf5_output_file if self.save_raw_hdf5 and self.raw_hdf5_output_file else None


@dataclass(frozen=True)
class SweepConfig:
    """An `optimize` run: a compress run and the block sizes to try."""

    base: CompressorConfig = field(default_factory=CompressorConfig)
    min_block_size: int = 4
    max_block_size: int = 32
    step_size: int = 1
    verbose: bool = False

    def problems(self, look: bool = True) -> list[str]:
        found = self.base.problems(look)
        for bad, said in (
            (self.min_block_size <= 0, "min_block_size must be greater than zero"),
            (self.max_block_size < self.min_block_size, "max_block_size must be greater than or equal to min_block_size"),
            (self.step_size <= 0, "step_size must be greater than zero"),
        ):
            if bad:
                found.append(said)
        return found

    def sizes(self) -> list[int]:
        return block_sizes(self.min_block_size, self.max_block_size, self.step_size)


def block_sizes(least: int = 4, most: int = 32, step: int = 1) -> list[int]:
    """The sizes of a sweep, held within 1 and MAX_BLOCK; none if the range is empty."""
    return list(range(max(1, least), min(MAX_BLOCK, most) + 1, step if step > 0 else 1))


#: The node whose parameters count first where a YAML file holds those of several (fixed name).
FIRST_NODE = "block_size_optimizer"


def parameters(text: str) -> dict:
    """The parameter mapping of a YAML document: that of FIRST_NODE, else of the first node that has
    `ros__parameters`, else `ros__parameters` at the top, else the top."""
    tree = yaml.safe_load(text) or {}
    if not isinstance(tree, dict):
        raise ValueError("the configuration isn't a mapping")
    nodes = [tree.get(FIRST_NODE), *(v for v in tree.values() if isinstance(v, dict) and isinstance(v.get("ros__parameters"), dict))]
    tree = next((n for n in nodes if isinstance(n, dict)), tree)
    return tree["ros__parameters"] if isinstance(tree.get("ros__parameters"), dict) else tree


def _made(kind, values: dict):
    known = {f.name: f for f in fields(kind) if f.name != "base"}
    types = {"str": str, "float": float, "int": int, "bool": bool}
    return {k: types[f.type](values[k]) for k, f in known.items() if values.get(k) is not None}


def compressor_config(text: str) -> CompressorConfig:
    return CompressorConfig(**_made(CompressorConfig, parameters(text)))


def sweep_config(text: str) -> SweepConfig:
    values = parameters(text)
    return SweepConfig(base=CompressorConfig(**_made(CompressorConfig, values)), **_made(SweepConfig, values))


def as_mapping(settings: CompressionSettings) -> dict:
    return asdict(settings)


def joined(problems: list[str]) -> str:
    """Non-empty messages as one."""
    return "; ".join(p for p in problems if p)
