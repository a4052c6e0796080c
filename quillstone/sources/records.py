"""Single assertions in Python, their dict form, and rows of the layouts in ``schema``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from datetime import datetime, timezone

from pyspark.sql import Row

from quillstone.functions.terms import DEFAULT_SCOPE


def now_iso() -> str:
    """UTC with microseconds, so that assertions made one after the other differ."""
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def canonical(value: object) -> str:
    return str(value or "").strip().lower()


def optional(value: object) -> object:
    return (value.strip() or None) if isinstance(value, str) else value


def to_json(value: dict) -> str:
    return json.dumps(value or {}, ensure_ascii=False, separators=(",", ":"))


def from_json(text: object) -> dict:
    """The object that a stored text holds; an empty one if it holds none."""
    try:
        value = json.loads(text) if text else {}
    except (TypeError, ValueError):
        return {}
    return value if isinstance(value, dict) else {}


@dataclass(frozen=True)
class Assertion:
    """A subject, predicate and object with scope, owner, times, confidence, provenance and attributes. Terms are stored stripped and
    in lower case; the object keeps its case if attribute ``literal`` is true."""

    subject: str
    predicate: str
    object: str
    scope: str = DEFAULT_SCOPE
    owner_id: str | None = None
    observed_at: str = field(default_factory=now_iso)
    valid_from: str | None = None
    valid_until: str | None = None
    confidence: float | None = None
    provenance: dict = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        attributes = self.attributes if isinstance(self.attributes, dict) else {}
        literal = bool(attributes.get("literal"))
        clean = {
            "subject": canonical(self.subject),
            "predicate": canonical(self.predicate),
            "object": str(self.object or "").strip() if literal else canonical(self.object),
            "scope": canonical(self.scope) or DEFAULT_SCOPE,
            "owner_id": optional(self.owner_id),
            "observed_at": optional(self.observed_at) or now_iso(),
            "valid_from": optional(self.valid_from),
            "valid_until": optional(self.valid_until),
        }
        for name, value in clean.items():
            object.__setattr__(self, name, value)

    def to_dict(self) -> dict:
        """All fields but those that are None, with copies of the maps."""
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return {n: dict(v) if isinstance(v, dict) else v for n, v in values.items() if v is not None}

    @classmethod
    def from_dict(cls, data: dict) -> Assertion:
        """TypeError if ``data`` is no dict, ValueError if a term is missing or blank; fields of a wrong type get their default."""
        if not isinstance(data, dict):
            raise TypeError("an assertion is made from a dict")
        for name in ("subject", "predicate", "object"):
            if not isinstance(data.get(name), str) or not data[name].strip():
                raise ValueError(f"{name} must be a string that is not blank")
        kinds = dict.fromkeys(("subject", "predicate", "object", "scope", "owner_id", "observed_at", "valid_from", "valid_until"), str)
        kinds |= dict.fromkeys(("provenance", "attributes"), dict)
        values = {n: data[n] for n, kind in kinds.items() if isinstance(data.get(n), kind)}
        try:
            values["confidence"] = float(data["confidence"])
        except (KeyError, TypeError, ValueError):
            pass
        return cls(**values)

    def given(self, vector: list[float] | None = None) -> dict:
        """A row of the layout GIVEN."""
        row = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("provenance", "attributes")}
        confidence = None if self.confidence is None else float(self.confidence)
        return row | {"confidence": confidence, "provenance_json": to_json(self.provenance), "attributes_json": to_json(self.attributes), "vector": vector}

    @classmethod
    def of_row(cls, row: Row) -> Assertion:
        """From a row of a result; its score goes to attribute ``_retrieval``, beside what that holds already."""
        data = row.asDict()
        names = [f.name for f in fields(cls) if f.name in data]
        out = cls(**{n: data[n] for n in names}, provenance=from_json(data["provenance_json"]), attributes=from_json(data["attributes_json"]))
        if "score" not in data:
            return out
        old = out.attributes.get("_retrieval")
        retrieval = {"metric": data["metric"], **(old if isinstance(old, dict) else {}), "score": data["score"], "distance": data["distance"]}
        return replace(out, attributes=out.attributes | {"_retrieval": retrieval})
