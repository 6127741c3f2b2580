"""Which graph a pattern is matched in."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Scope:
    """default: graphs of FROM (None: all triples); named: those of FROM NAMED (None: all); graph: that of GRAPH <iri>; var: that of GRAPH ?g."""

    default: tuple[str, ...] | None = None
    named: tuple[str, ...] | None = None
    graph: str | None = None
    var: str | None = None

    def allows(self, graph: str | None) -> bool:
        if self.graph is not None:
            return graph == self.graph and (self.named is None or graph in self.named)
        if self.var is not None:
            return graph is not None and (self.named is None or graph in self.named)
        return self.default is None or graph in self.default
