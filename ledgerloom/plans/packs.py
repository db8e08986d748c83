"""Packs: JSON files that hold all knowledge of a corpus, read and checked on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ledgerloom.functions.coerce import COERCIONS
from ledgerloom.operators.detectors import Detector


class PackError(ValueError):
    """A pack that cannot be used, with the reason."""


@dataclass
class Source:
    """One source of a table: which group, what to explode, where each column comes from."""

    group: str
    paths: dict[str, str] = field(default_factory=dict)
    const: dict[str, object] = field(default_factory=dict)
    explode: str | None = None


@dataclass
class TableMapping:
    name: str
    sources: list[Source]
    types: dict[str, str] = field(default_factory=dict)
    derived: list[tuple[str, str]] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.sources for c in [*s.paths, *s.const]))


def _read(path: str | Path) -> dict:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise PackError(f"{path}: {e}") from e


def load_mapping(path: str | Path, views: list[tuple[str, str]] | None = None) -> list[TableMapping]:
    """Tables of a mapping pack; the statements of its ``post_sql`` become derived steps.

    Views are added to ``views`` as (name, SQL); without it a pack that has some is refused.
    """
    raw = _read(path)
    tables = []
    for name, t in raw.get("tables", {}).items():
        sources = [Source(s["group"], s.get("paths", {}), s.get("const", {}), s.get("explode")) for s in t.get("sources", []) if "group" in s]
        if not sources:
            raise PackError(f"{name}: no source with a group")
        bad = {k for k in t.get("types", {}).values()} - set(COERCIONS)
        if bad:
            raise PackError(f"{name}: unknown types {sorted(bad)}")
        tables.append(TableMapping(name, sources, t.get("types", {}), [tuple(x) for x in t.get("derived", [])]))
    from ledgerloom.operators.normalise import derive_from_sql

    for statement in raw.get("post_sql", []):
        derive_from_sql(statement, {f"norm_{t.name}": t for t in tables}, views)
    return tables


def load_detectors(path: str | Path) -> list[Detector]:
    """Detectors of a pack; each must carry its innocent explanations."""
    out = []
    for d in _read(path).get("detectors", []):
        if not d.get("innocent_explanations"):
            raise PackError(f"{d.get('id')}: innocent_explanations are missing")
        out.append(Detector(d["id"], d["template"], d.get("params", {}), d["innocent_explanations"], bool(d.get("legal_flag", d["template"] == "gap")), d.get("defamation_tier", "named_org"), d.get("signal_type", "")))
    return out


def load_entities(path: str | Path) -> dict:
    """Entity columns with their types, the least length of a normal form, and patterns of composites."""
    raw = _read(path)
    return {"columns": [(c["table"], c["column"], c["type"]) for c in raw.get("entity_columns", [])], "least_length": raw.get("min_norm_len", 5), "composites": raw.get("intermediary_patterns", [])}


def load_mentions(path: str | Path) -> dict:
    """Where to search, for which names, with which guards, and the table that takes the mentions."""
    raw = _read(path)
    try:
        docs, names = raw["docs"], raw["entities"]
        return {
            "table": docs["table"], "text": docs["text_col"], "carry": list(docs.get("carry_cols", [])), "names": names["query"],
            "least_length": int(names.get("min_len", 10)), "stop": list(names.get("stop_names", [])), "out": raw["out_table"],
        }
    except (KeyError, TypeError) as e:
        raise PackError(f"{path}: {e!r} is missing") from e


def load_semantic(path: str | Path) -> dict:
    """Spaces and, if there is one, the bridge of a semantic pack, checked for what they need."""
    raw = _read(path)
    for s in raw.get("spaces", []):
        lacking = [k for k in ("name", "table", "text_col", "id_cols") if not s.get(k)]
        if lacking:
            raise PackError(f"{path}: space {s.get('name')!r} lacks {', '.join(lacking)}")
    bridge = raw.get("bridge")
    if bridge is not None:
        known = {s["name"] for s in raw.get("spaces", [])}
        for k in ("press_space", "desc_space"):
            if bridge.get(k) not in known:
                raise PackError(f"{path}: bridge {k} {bridge.get(k)!r} is no space of the pack")
        if not bridge.get("anchors"):
            raise PackError(f"{path}: a bridge needs anchors; unanchored likeness is coincidence")
    return raw
