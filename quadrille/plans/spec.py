"""An analysis' settings as one record that can be stored, shared and undone."""

from __future__ import annotations

import base64
import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class AnalysisSpec:
    method: str | None = None
    vars: tuple[str, ...] = ()
    supplementary: tuple[str, ...] = ()
    color: str | None = None
    ident: str | None = None
    axes: int | None = None
    transforms: dict = field(default_factory=dict)
    missing: str = "drop"
    types: dict = field(default_factory=dict)
    filters: tuple = ()
    selection: str = ""
    target: str | None = None

    def with_role(self, column: str, role: str) -> AnalysisSpec:
        """active, illustrative, colour, identifier or ignored."""
        out = replace(self, vars=tuple(v for v in self.vars if v != column), supplementary=tuple(v for v in self.supplementary if v != column), color=None if self.color == column else self.color, ident=None if self.ident == column else self.ident)
        match role:
            case "active":
                return replace(out, vars=(*out.vars, column))
            case "illustrative":
                return replace(out, supplementary=(*out.supplementary, column))
            case "colour":
                return replace(out, color=column)
            case "identifier":
                return replace(out, ident=column)
        return out

    def pruned(self, columns: list[str]) -> AnalysisSpec:
        """Without columns that the table no longer has."""
        return replace(self, vars=tuple(v for v in self.vars if v in columns), supplementary=tuple(v for v in self.supplementary if v in columns), color=self.color if self.color in columns else None, ident=self.ident if self.ident in columns else None)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> AnalysisSpec:
        d = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in cls.__dataclass_fields__})

    def to_link(self) -> str:
        return base64.urlsafe_b64encode(self.to_json().encode()).decode().rstrip("=")

    @classmethod
    def from_link(cls, text: str) -> AnalysisSpec:
        return cls.from_json(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode())


class History:
    """Undo and redo of settings."""

    def __init__(self, spec: AnalysisSpec, depth: int = 80):
        self.past, self.future, self.now, self.depth = [], [], spec, depth

    def put(self, spec: AnalysisSpec) -> AnalysisSpec:
        self.past, self.future, self.now = [*self.past, self.now][-self.depth :], [], spec
        return spec

    def undo(self) -> AnalysisSpec:
        if self.past:
            self.future.append(self.now)
            self.now = self.past.pop()
        return self.now

    def redo(self) -> AnalysisSpec:
        if self.future:
            self.past.append(self.now)
            self.now = self.future.pop()
        return self.now
