"""Every constant of the engine, in one place; pass a changed copy to vary it."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    rrf_k: int = 60
    rank_depth: int = 100
    panel_size: int = 3
    kg_top: int = 12
    retrieval_mix: tuple[float, float] = (0.82, 0.18)
    semantic_floor: float = 0.40
    coi_threshold: float = 0.5
    junior_capacity: int = 6
    mid_capacity: int = 10
    senior_authority_capacity: int = 12
    senior_capacity: int = 15
    near_capacity: float = 0.90
    authority_mix: tuple[float, float] = (0.7, 0.3)
    authority_cap: float = 0.80
    redundancy: float = 0.6
    bm25: tuple[float, float] = (1.5, 0.75)


#: The ablation weights by mode, for (semantic, graph, profile).
MODES = {"semantic": (1.0, 0.0, 0.0), "semantic_kg": (0.5, 0.5, 0.0), "semantic_llm": (0.5, 0.0, 0.5), "semantic_kg_llm": (0.34, 0.33, 0.33)}
#: The weight triples of the grid search.
GRID = [(0.90, 0.10, 0.00), (0.85, 0.15, 0.00), (0.80, 0.20, 0.00), (0.75, 0.20, 0.05), (0.70, 0.25, 0.05), (0.70, 0.20, 0.10), (0.65, 0.25, 0.10)]
