"""Query plans: categories, tool registry, ordered lazy steps."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

# Fixed values.
PATHS = {"STATIC": ("STATIC", ("vector_search",)), "CALL_PATH": ("DYNAMIC", ("call_path_analyzer",)), "CONFIG": ("DYNAMIC", ("config_impact_analyzer",)), "ERROR": ("DYNAMIC", ("error_chain_mapper",)), "CROSS_REPO": ("DYNAMIC", ("cross_repo_tracer",)), "HYBRID": ("HYBRID", ("vector_search",)), "INTERNET": ("HYBRID", ("internet_data",))}


@dataclass
class Step:
    tool: str
    parameters: dict[str, Any]
    priority: int = 0
    required: bool = False


@dataclass
class Plan:
    query: str
    path: str
    steps: list[Step]
    context: dict[str, Any] = field(default_factory=dict)


@dataclass
class Result:
    answers: dict[str, DataFrame]
    errors: dict[str, str]
    failed: bool = False


class Registry:
    """Tools by unique, non-blank name; each takes parameters and gives a frame."""

    def __init__(self) -> None:
        self._tools: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, run: Callable[..., DataFrame]) -> None:
        if not name or not name.strip() or run is None:
            raise ValueError("a tool needs a name and a function")
        if name in self._tools:
            raise ValueError(f"{name} is registered already")
        self._tools[name] = run

    def get(self, name: str) -> Callable[..., DataFrame] | None:
        return self._tools.get(name)

    def remove(self, name: str) -> bool:
        return self._tools.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._tools)

    def __len__(self) -> int:
        return len(self._tools)


def parse_category(answer: str | None) -> tuple[str, float, tuple[str, ...]]:
    """``CATEGORY|confidence|tool,tool``; anything else is a static search at 0.5."""
    parts = (answer or "").split("|")
    try:
        category, confidence = parts[0].strip().upper(), float(parts[1])
        if category not in PATHS:
            raise ValueError(category)
    except (IndexError, ValueError):
        return "STATIC", 0.5, ("vector_search",)
    tools = tuple(t.strip() for t in parts[2].split(",") if t.strip()) if len(parts) > 2 else ()
    return category, max(0.0, min(1.0, confidence)), tools or PATHS[category][1]


def make_plan(query: str, category: str, tools: tuple[str, ...], registry: Registry, parameters: dict[str, dict[str, Any]] | None = None) -> Plan:
    """The vector step first, then the other known tools where the path runs them; each gets its own parameters."""
    path, steps = PATHS[category][0], []
    if registry.get("vector_search"):
        steps.append(Step("vector_search", {"query": query}, 0, True))
    if path in ("HYBRID", "DYNAMIC"):
        steps += [Step(t, {"query": query} | (parameters or {}).get(t, {}), n, False) for n, t in enumerate((t for t in tools if t != "vector_search" and registry.get(t)), 1)]
    return Plan(query, path, steps)


def execute(plan: Plan, registry: Registry) -> Result:
    """Steps by priority, lowest first; a failed required step ends the run."""
    out = Result({}, {})
    for step in sorted(plan.steps, key=lambda s: s.priority):
        try:
            tool = registry.get(step.tool)
            if tool is None:
                raise KeyError(step.tool)
            out.answers[step.tool] = plan.context[step.tool] = tool(**step.parameters)
        except Exception as e:  # noqa: BLE001  a tool's failure is a result
            out.errors[step.tool] = str(e)
            if step.required:
                out.failed = True
                break
    return out


def status(total: int, failed: int) -> str:
    return "success" if failed == 0 else "error" if failed >= total else "partial_success"


def answer(plan: Plan, registry: Registry, fallback: Callable[[str], DataFrame]) -> Result:
    """The plan's result, or the fallback's as ``static`` where a required step fails."""
    out = execute(plan, registry)
    if out.failed:
        out.answers["static"] = fallback(plan.query)
    return out


def error_category(e: BaseException) -> str:
    if isinstance(e, TimeoutError):
        return "EXECUTION_TIMEOUT"
    if isinstance(e, InterruptedError):
        return "EXECUTION_INTERRUPTED"
    if isinstance(e, (ValueError, TypeError)):
        return "INVALID_PARAMETERS"
    return "RESOURCE_EXHAUSTION" if isinstance(e, MemoryError) or isinstance(e.__cause__, MemoryError) else "EXECUTION_ERROR"


def is_retryable(e: BaseException) -> bool:
    """Whether another try may help: not for wrong parameters, timeouts or exhausted memory."""
    return error_category(e) in ("EXECUTION_ERROR", "EXECUTION_INTERRUPTED")


def retried(run: Callable[[], Any], retries: int = 3, wait: float = 1.0, factor: float = 1.0, jitter: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """``run()``, again up to ``retries`` times while its errors are retryable.

    The pause is fixed, or grows by ``factor``; up to a share of ``jitter`` is added by chance.
    """
    for n in range(retries + 1):
        try:
            return run()
        except Exception as e:
            if n == retries or not is_retryable(e):
                raise
            sleep(wait * factor**n * (1 + jitter * random.random()))
