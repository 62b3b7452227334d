"""Settings of the graph index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from .errors import InvalidConfig

#: Ways to shorten the list of a neighbour that has got too many links.
PRUNE_STRATEGIES = ("simple", "heuristic")


@dataclass(frozen=True)
class IndexConfig:
    """m: links of a node above the base layer; m0: in the base layer (2 m if None); ef_construction: candidates of an insert;
    shards: by the number of rows if None."""

    m: int = 16
    m0: int | None = None
    ef_construction: int = 200
    use_heuristic: bool = True
    extend_candidates: bool = False
    keep_pruned: bool = True
    prune_strategy: str = "simple"
    shards: int | None = None
    seed: int = 0

    def __post_init__(self):
        if self.m0 is None:
            object.__setattr__(self, "m0", 2 * self.m)
        if self.m < 2:
            raise InvalidConfig("m must be at least 2")
        if self.ef_construction < self.m:
            raise InvalidConfig("ef_construction must be at least m")
        if self.m0 < self.m:
            raise InvalidConfig("m0 must be at least m")
        if self.prune_strategy not in PRUNE_STRATEGIES:
            raise InvalidConfig(f"prune_strategy must be one of {PRUNE_STRATEGIES}")
        if self.shards is not None and self.shards < 1:
            raise InvalidConfig("shards must be at least 1")

    def max_links(self, layer: int) -> int:
        return self.m0 if layer == 0 else self.m

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> IndexConfig:
        return cls(**json.loads(text))


class Builder:
    """Collects settings by name, then makes tables and graphs: Builder().m(32).shards(8).build_graph(table)."""

    def __init__(self, config: IndexConfig | None = None):
        self.config = config or IndexConfig()
        self.metric_name = "euclidean"

    def _with(self, **changes) -> Builder:
        out = Builder(replace(self.config, **changes))
        out.metric_name = self.metric_name
        return out

    def m(self, value: int) -> Builder:
        m0 = None if self.config.m0 == 2 * self.config.m else self.config.m0
        return self._with(m=value, m0=m0)

    def m0(self, value: int) -> Builder:
        return self._with(m0=value)

    def ef_construction(self, value: int) -> Builder:
        return self._with(ef_construction=value)

    def use_heuristic(self, value: bool) -> Builder:
        return self._with(use_heuristic=value)

    def extend_candidates(self, value: bool) -> Builder:
        return self._with(extend_candidates=value)

    def keep_pruned(self, value: bool) -> Builder:
        return self._with(keep_pruned=value)

    def prune_strategy(self, value: str) -> Builder:
        return self._with(prune_strategy=value)

    def shards(self, value: int | None) -> Builder:
        return self._with(shards=value)

    def seed(self, value: int) -> Builder:
        return self._with(seed=value)

    def metric(self, name: str) -> Builder:
        out = self._with()
        out.metric_name = name
        return out

    def build(self, vectors, **columns):
        from .table import VectorTable

        return VectorTable.create(vectors, metric=self.metric_name, **columns)

    def build_labeled(self, vectors, payload: list[str], **columns):
        from .table import VectorTable

        return VectorTable.create(vectors, metric=self.metric_name, payload=payload, **columns)

    def build_paired(self, vectors, a: str, b: str, metric_a: str | None = None, metric_b: str | None = None, **columns):
        from .table import PairedTable

        return PairedTable.create(vectors, a, b, metric_a or self.metric_name, metric_b or self.metric_name, **columns)

    def build_graph(self, table):
        from .operators.graph import build

        return build(table, self.config)
