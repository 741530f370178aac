"""Settings of the preparation plan, from YAML or code."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from .operators.rules import DRUG_LIKE_RANGES


@dataclass
class Settings:
    """What ``plans.prepare`` does at each step."""

    key_column: str = "smiles"
    row_id: str = "row_id"
    target_column: str | None = None
    remove_salts: bool = True
    keep: str = "first"
    ranges: dict = field(default_factory=lambda: {k: dict(v) for k, v in DRUG_LIKE_RANGES.items()})
    n_bits: int = 2048
    radius: int = 2
    split_method: str = "random"
    train_ratio: float = 0.7
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    group_column: str = "scaffold"
    date_column: str = "publication_date"
    seed: int = 42

    @classmethod
    def from_dict(cls, raw: dict) -> "Settings":
        """From the nested layout of a data configuration, or flat names."""
        known = {f.name for f in fields(cls)}
        out = cls(**{k: v for k, v in raw.items() if k in known})
        cleaning = raw.get("preprocessing") or {}
        out.remove_salts = (cleaning.get("standardization") or {}).get("remove_salts", out.remove_salts)
        out.keep = (cleaning.get("deduplication") or {}).get("keep", out.keep)
        out.ranges = cleaning.get("quality_filters") or out.ranges
        morgan = ((raw.get("feature_extraction") or {}).get("fingerprints") or {}).get("morgan") or {}
        out.n_bits, out.radius = morgan.get("n_bits", out.n_bits), morgan.get("radius", out.radius)
        ratios = (raw.get("data_splitting") or {}).get("scaffold" if out.split_method == "scaffold" else "random") or {}
        for name in ("train_ratio", "val_ratio", "test_ratio"):
            setattr(out, name, ratios.get(name, getattr(out, name)))
        return out

    @classmethod
    def from_yaml(cls, path: str) -> "Settings":
        import yaml

        with open(path) as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})

    @property
    def ratios(self) -> dict[str, float]:
        return {"train": self.train_ratio, "val": self.val_ratio, "test": self.test_ratio}
