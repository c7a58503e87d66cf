"""The modules that hold queries and their SQL."""

from __future__ import annotations

from types import ModuleType

from lorevault.plans import claims, episodes, heavy, memory, procedures, recall, retrieval, skills, upkeep


def modules() -> list[ModuleType]:
    return [heavy, episodes, retrieval, procedures, memory, recall, skills, claims, upkeep]
