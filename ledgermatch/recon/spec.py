"""What to compare: options of one dataset and of a whole suite."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

DEFAULT_SAMPLE_ROWS = 5
DEFAULT_LIST = "data_list"


@dataclass(frozen=True)
class CheckSpec:
    """Options of one dataset.

    ``mapping`` renames columns on both sides to the target's name; ``exclude``
    drops columns afterwards, so it uses the names after mapping. ``bag`` counts
    a row as different when only its number of copies differs (EXCEPT ALL); by
    default rows are compared as a set. ``digest`` compares SHA-256 digests of the
    rows: for wide rows it shuffles 32 bytes per row in place of the row.
    """

    name: str
    mapping: dict[str, str] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    sample_rows: int = DEFAULT_SAMPLE_ROWS
    bag: bool = False
    digest: bool = False


@dataclass
class CheckSuite:
    """Named lists of datasets with their options.

    Options come from hand-written configuration, so an entry of the wrong type
    is left out and a bad number falls back to its default; only a missing
    dataset list is an error. ``bag`` and ``digest`` name the datasets they apply to, or
    are true for all. ``samples`` asks for samples of differing rows; left out, ``debug``
    decides when the suite comes from a configuration, and they are taken otherwise.
    """

    lists: dict[str, list[str]]
    check_list: Any = DEFAULT_LIST
    data_dir: str = "data"
    mapping_fields: Any = field(default_factory=dict)
    exclude_fields: Any = field(default_factory=dict)
    sample_diff_rows: Any = DEFAULT_SAMPLE_ROWS
    debug: Any = 0
    bag: Any = False
    digest: Any = False
    samples: bool | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.check_list, str) or not self.check_list.strip():
            self.check_list = DEFAULT_LIST
        self.debug = _whole_number(self.debug, 0)
        rows = _whole_number(self.sample_diff_rows, DEFAULT_SAMPLE_ROWS)
        self.sample_diff_rows = rows if rows > 0 else DEFAULT_SAMPLE_ROWS
        self.mapping_fields = _clean_mappings(self.mapping_fields)
        self.exclude_fields = _clean_excludes(self.exclude_fields)
        self.datasets  # an empty suite is refused at once

    @property
    def datasets(self) -> list[str]:
        """The selected list; the default list stands in for an unknown name."""
        chosen = self.lists.get(self.check_list)
        if chosen is None:
            chosen = self.lists.get(DEFAULT_LIST)
        if not isinstance(chosen, list) or not chosen:
            raise ValueError(f"check list '{self.check_list}' is missing or empty")
        return [str(name) for name in chosen]

    def spec(self, dataset: str) -> CheckSpec:
        return CheckSpec(
            name=dataset,
            mapping=self.mapping_fields.get(dataset, {}),
            exclude=tuple(self.exclude_fields.get(dataset, ())),
            sample_rows=0 if self.samples is False else self.sample_diff_rows,
            bag=_applies(self.bag, dataset),
            digest=_applies(self.digest, dataset),
        )

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> CheckSuite:
        """Build from the nested layout with ``data_checks`` and ``run_mode``."""
        checks = config.get("data_checks") or {}
        run = config.get("run_mode") or {}
        options = ("data_dir", "mapping_fields", "exclude_fields")
        return cls(
            lists={k: v for k, v in checks.items() if k not in options},
            check_list=run.get("check_list"),
            data_dir=checks.get("data_dir", "data"),
            mapping_fields=checks.get("mapping_fields", {}),
            exclude_fields=checks.get("exclude_fields", {}),
            sample_diff_rows=run.get("sample_diff_rows", DEFAULT_SAMPLE_ROWS),
            debug=run.get("debug", 0),
            bag=run.get("bag", False),
            digest=run.get("digest", False),
            samples=_whole_number(run["debug"], 0) > 0 if "debug" in run else None,
        )


def _applies(option: Any, dataset: str) -> bool:
    return dataset in option if isinstance(option, list | tuple | set) else option is True


def _whole_number(value: Any, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def _texts_only(items: Any) -> list[str]:
    return [i for i in items if isinstance(i, str)]


def _clean_mappings(raw: Any) -> dict[str, dict[str, str]]:
    if not isinstance(raw, dict):
        return {}
    clean = {
        name: {s: t for s, t in fields.items() if isinstance(s, str) and isinstance(t, str)}
        for name, fields in raw.items()
        if isinstance(name, str) and isinstance(fields, dict)
    }
    return {name: fields for name, fields in clean.items() if fields}


def _clean_excludes(raw: Any) -> dict[str, list[str]]:
    if not isinstance(raw, dict):
        return {}
    return {
        name: _texts_only(fields)
        for name, fields in raw.items()
        if isinstance(name, str) and isinstance(fields, list)
    }
