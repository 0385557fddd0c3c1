"""Ports to outside helpers: a model that completes a question, a runner that works with tools. None is bound to a provider.

Both hand back plain dicts that have been held against a schema at the boundary, so that callers meet either the promised shape or an error,
which they turn into their deterministic way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol


class SchemaError(ValueError):
    """An answer that does not have the promised shape."""


@dataclass(frozen=True)
class Field:
    """One field: its type, whether it must be there, the schema of its parts if it is a list of objects, and the values it may have."""

    kind: type | tuple[type, ...]
    required: bool = False
    each: Mapping[str, Field] | None = None
    among: tuple | None = None


Schema = Mapping[str, Field]
#: A table that a proposer names; regions are A1 texts, rows count from 1.
TABLE: Schema = {"region": Field(str, True), "header_row": Field(int, True), "header_span": Field(int), "orientation": Field(str, among=("vertical", "transposed"))}
LAYOUT: Schema = {"tables": Field(list, each=TABLE), "rationale": Field(str)}
COLUMN: Schema = {"name": Field(str, True), "dtype": Field(str), "unit": Field(str), "role": Field(str)}
BAND_PATCH: Schema = {"columns": Field(list, each=COLUMN), "anomalies": Field(list)}
TABLE_PATCH: Schema = {"column_patches": Field(list, each=COLUMN), "header_row": Field(int), "header_span": Field(int), "columns": Field(list, each=COLUMN), "anomalies": Field(list)}
VERDICT: Schema = {"choice": Field(int, True), "rationale": Field(str)}
COORDINATE: Schema = {"found": Field(bool, True), "table_id": Field(str), "row_label": Field(str), "col_label": Field(str)}
HEADER_CHECK: Schema = {"columns": Field(list, each={"name": Field(str, True), "unit": Field(str), "role": Field(str)})}
MESSY_TAB: Schema = {"confident": Field(bool, True), "header_row": Field(int), "region": Field(str), "columns": Field(list, each={"name": Field(str, True), "dtype": Field(str)})}


def enforce(raw: Any, schema: Schema | None) -> dict:
    """The answer with the schema's fields only, nulls left out; SchemaError if a field is missing, of another type, or of another value."""
    if schema is None:
        return raw
    if not isinstance(raw, Mapping):
        raise SchemaError(f"an object was asked for, not {type(raw).__name__}")
    out = {}
    for name, spec in schema.items():
        value = raw.get(name)
        if value is None:
            if spec.required:
                raise SchemaError(f"{name} is missing")
            continue
        if not isinstance(value, spec.kind) or (spec.kind is int and isinstance(value, bool)):
            raise SchemaError(f"{name} is {type(value).__name__}")
        if spec.among and value not in spec.among:
            raise SchemaError(f"{name} is {value!r}")
        out[name] = [enforce(v, spec.each) for v in value] if spec.each and isinstance(value, list) else value
    if schema is MESSY_TAB and out["confident"] and not all(out.get(k) for k in ("header_row", "region", "columns")):
        raise SchemaError("a confident answer needs header_row, region and columns")
    return out


class Client(Protocol):
    def complete(self, system: str, user: str, *, schema: Schema | None = None) -> dict: ...


class Runner(Protocol):
    def run(self, seed: str, tools: Sequence[Tool], *, schema: Schema | None = None, system: str | None = None) -> dict: ...


@dataclass(frozen=True)
class Tool:
    """A named probe: what it does, the JSON schema of its arguments, and the function from arguments to a JSON value."""

    name: str
    about: str
    arguments: dict
    call: Callable[[dict], dict]


@dataclass
class ScriptedClient:
    """Answers one after the other, or by a function of the question; remembers what it was asked. It fails when the script is over."""

    answers: Sequence[dict] | Callable[..., dict]
    asked: list[dict] = field(default_factory=list)

    def complete(self, system: str, user: str, *, schema: Schema | None = None) -> dict:
        self.asked.append({"system": system, "user": user})
        raw = self.answers(system=system, user=user) if callable(self.answers) else self.answers[len(self.asked) - 1]
        return enforce(raw, schema)


@dataclass
class ScriptedRunner:
    """Calls the scripted tools, keeps what they say, and gives the scripted answers in turn, the last one again and again."""

    finals: Sequence[dict] | Callable[[str], dict]
    actions: Sequence[tuple[str, dict]] = ()
    seen: list = field(default_factory=list)
    seeds: list[str] = field(default_factory=list)

    def run(self, seed: str, tools: Sequence[Tool], *, schema: Schema | None = None, system: str | None = None) -> dict:
        self.seeds.append(seed)
        by_name = {t.name: t for t in tools}
        self.seen += [by_name[name].call(arguments) for name, arguments in self.actions]
        raw = self.finals(seed) if callable(self.finals) else self.finals[min(len(self.seeds), len(self.finals)) - 1]
        return enforce(raw, schema)


def allowed_tools(tools: Sequence[Tool], prefix: str = "") -> list[str]:
    """The names under which a runner may call the tools, and no others."""
    return [prefix + t.name for t in tools]


def as_json(value: object) -> str:
    return json.dumps(value, default=str, ensure_ascii=False)
