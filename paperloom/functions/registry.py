"""Extensions: registered functions and interceptors around a DataFrame step."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


@dataclass
class Registry:
    """Extensions by name, with the permissions each was granted; built-in ones have all."""

    functions: dict[str, Callable] = field(default_factory=dict)
    permissions: dict[str, set[str]] = field(default_factory=dict)
    before: list[tuple[str, Callable[[DataFrame], DataFrame | None]]] = field(default_factory=list)
    after: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def register(self, owner: str, name: str, function: Callable, *granted: str) -> None:
        self.functions[f"{owner}.{name}"] = function
        self.permissions.setdefault(owner, set()).update(granted)

    def allowed(self, owner: str, permission: str) -> bool:
        return owner.startswith("__") or permission in self.permissions.get(owner, set())

    def intercept(self, df: DataFrame, step: Callable[[DataFrame], DataFrame], caller: str = "") -> DataFrame | None:
        """Runs a step between its interceptors; one before may cancel it by None. The caller's own are skipped, and
        so is one that fails as it builds its plan; one after that gives nothing changes nothing."""
        for owner, hook in self.before:
            if owner != caller:
                try:
                    df = hook(df)
                except Exception:
                    log.warning("an interceptor of %s failed", owner, exc_info=True)
                if df is None:
                    return None
        df = step(df)
        for owner, hook in self.after:
            if owner != caller:
                try:
                    found = hook(df)
                    df = df if found is None else found
                except Exception:
                    log.warning("an interceptor of %s failed", owner, exc_info=True)
        return df
