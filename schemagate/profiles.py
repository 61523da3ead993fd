"""Declarative profiles: target columns, how to normalize them, which rules they must pass."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from functools import lru_cache
from pathlib import Path
from typing import Any

from schemagate.functions.booleans import BOOLEAN_WORDS
from schemagate.functions.dates import DEFAULT_DATE_FORMATS
from schemagate.functions.numbers import DECIMAL_SEPARATORS, THOUSAND_SEPARATORS

FIELD_TYPES = ("string", "integer", "decimal", "date", "datetime", "boolean", "email", "url", "phone")
BUNDLED = Path(__file__).parent / "resources"


@dataclass(frozen=True)
class FieldSpec:
    sources: tuple[str, ...]
    type: str = "string"
    format: tuple[str, ...] = ()
    required: bool = False
    default: Any = None
    validation: Mapping[str, Any] = field(default_factory=dict)
    transformation: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class NormalizationSpec:
    thousand_sep: tuple[str, ...] = THOUSAND_SEPARATORS
    decimal_sep: tuple[str, ...] = DECIMAL_SEPARATORS
    trim_whitespace: bool = True
    normalize_unicode: bool = True
    date_formats: tuple[str, ...] = DEFAULT_DATE_FORMATS
    boolean_values: Mapping[str, bool] = field(default_factory=lambda: dict(BOOLEAN_WORDS))


@dataclass(frozen=True)
class OutputSpec:
    format: str = "csv"
    filename_template: str = "{profile}_{org_id}_{timestamp}"
    date_format: str = "%Y-%m-%d"
    decimal_places: int = 2
    null_representation: str = ""


@dataclass(frozen=True)
class CrossRule:
    """A rule over several columns of a row, written as SQL expressions."""

    column: str
    needs: tuple[str, ...]
    condition: str
    reason: str
    severity: str = "warning"


@dataclass(frozen=True)
class Profile:
    profile: str
    columns: Mapping[str, FieldSpec]
    version: str = "1.0"
    description: str | None = None
    normalization: NormalizationSpec = field(default_factory=NormalizationSpec)
    date_range: Mapping[str, str] = field(default_factory=dict)
    output: OutputSpec = field(default_factory=OutputSpec)
    cross_rules: tuple[CrossRule, ...] = ()
    tags: tuple[str, ...] = ()

    @property
    def targets(self) -> list[str]:
        return list(self.columns)

    def required_fields(self) -> list[str]:
        return [name for name, spec in self.columns.items() if spec.required]

    def source_columns(self) -> list[str]:
        return sorted({s for spec in self.columns.values() for s in spec.sources})

    def field_by_source(self, source: str) -> tuple[str, FieldSpec] | None:
        """First target that lists ``source`` among its aliases."""
        return next(((n, s) for n, s in self.columns.items() if source in s.sources), None)

    def aliases(self) -> list[tuple[str, str, int]]:
        """(target, lower-case alias, rank) of every alias."""
        return [(n, a.lower(), r) for n, s in self.columns.items() for r, a in enumerate(s.sources)]


def _known(cls: type, raw: Mapping[str, Any]) -> dict[str, Any]:
    names = {f.name for f in fields(cls)}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in names and v is not None}


def profile_from_dict(raw: Mapping[str, Any]) -> Profile:
    name = str(raw["profile"]).strip().lower()
    if not name or not all(ch.isalnum() or ch in "_-" for ch in name):
        raise ValueError(f"bad profile name: {raw['profile']!r}")
    columns = {}
    for target, spec in raw["columns"].items():
        known = _known(FieldSpec, spec)
        if not known.get("sources"):
            raise ValueError(f"column {target} lists no sources")
        if isinstance(known.get("format"), str):
            known["format"] = (known["format"],)
        column = FieldSpec(**known)
        if column.type not in FIELD_TYPES:
            raise ValueError(f"column {target} has unknown type {column.type}")
        columns[target] = column
    return Profile(
        profile=name,
        columns=columns,
        version=str(raw.get("version", "1.0")),
        description=raw.get("description"),
        normalization=NormalizationSpec(**_known(NormalizationSpec, raw.get("normalization") or {})),
        date_range=(raw.get("validation") or {}).get("date_range") or {},
        output=OutputSpec(**_known(OutputSpec, raw.get("output") or {})),
        cross_rules=tuple(CrossRule(**_known(CrossRule, r)) for r in raw.get("cross_rules") or ()),
        tags=tuple(raw.get("tags") or ()),
    )


def read_profile(path: str | Path) -> Profile:
    """Read a profile from a .json, .yaml or .yml file."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix.lower() == ".json":
        return profile_from_dict(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML profiles need PyYAML; JSON profiles do not") from e
    return profile_from_dict(yaml.safe_load(text))


@lru_cache(maxsize=None)
def load_profile(name: str, directory: str | Path = BUNDLED) -> Profile:
    """Profile by name; each is read once."""
    for suffix in (".json", ".yaml", ".yml"):
        path = Path(directory) / f"{name}{suffix}"
        if path.exists():
            return read_profile(path)
    raise FileNotFoundError(f"no profile {name} in {directory}")
