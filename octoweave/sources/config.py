"""Experiment configuration: YAML or JSON, with precedence command line, then file, then default."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields

try:
    import yaml
except ImportError:  # JSON is YAML enough then
    yaml = None


@dataclass
class Config:
    name: str = "experiment"
    file_path: str = ""
    file_to_compress: str = ""
    device: str = "cpu"
    precision: str = "fp32"
    progress: bool = True
    model_path: str = ""
    use_vocab_subset: bool = False
    seq_len: int = 4096
    batch_size: int = 8
    d_model: int = 64
    num_layers: int = 1
    lr: float = 5e-4
    epochs: int = 1
    chunks_count: int = 0
    seq_size: int = 4096
    order: int = 1
    splits: list[float] = field(default_factory=lambda: [0.8, 0.1, 0.1])


_SECTIONS = ("dataloader", "model", "training", "compression")


def resolve(name: str, root: str = ".") -> str:
    """A path as given, or experiments/<name>/<name>.yaml, or configs/<name>.yaml below the root."""
    for path in (name, os.path.join(root, "experiments", name, f"{name}.yaml"), os.path.join(root, "configs", f"{name}.yaml")):
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"no configuration {name!r}")


def load(path: str, **given) -> Config:
    """The file's settings under those given; a model that is named must exist; splits that are none become the default."""
    with open(path, encoding="utf-8") as f:
        raw = (yaml.safe_load if yaml else json.load)(f) or {}
    flat = {k: v for k, v in raw.items() if k not in _SECTIONS}
    for section in _SECTIONS:
        flat |= raw.get(section) or {}
    flat |= {k: v for k, v in given.items() if v is not None}
    known = {f.name for f in fields(Config)}
    config = Config(**{k: v for k, v in flat.items() if k in known})
    try:
        config.splits = [float(x) for x in config.splits]
        if len(config.splits) != 3 or abs(sum(config.splits) - 1) >= 1e-6:
            raise ValueError
    except (TypeError, ValueError):
        config.splits = [0.8, 0.1, 0.1]
    if config.model_path and not os.path.isfile(config.model_path):
        raise FileNotFoundError(f"the model {config.model_path!r} does not exist")
    return config


def save(config: Config, path: str) -> None:
    raw = {f.name: getattr(config, f.name) for f in fields(Config)}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(raw, f, sort_keys=True) if yaml else json.dump(raw, f)


def latest_checkpoint(paths: list[str]) -> str | None:
    """The path of the highest epoch in its name."""
    numbered = [(int(m[1]), p) for p in paths if (m := re.search(r"epoch_?(\d+)", os.path.basename(p)))]
    return max(numbered)[1] if numbered else None
