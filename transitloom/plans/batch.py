"""Several runs one after the other."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Outcome:
    command: str
    error: str | None


def run_all(commands: Iterable[str], run: Callable[[str], None]) -> tuple[list[Outcome], int]:
    """Every command's outcome, and the exit code: 1 if one failed. A failure does not keep the others from running."""
    outcomes = []
    for command in commands:
        try:
            run(command)
            outcomes.append(Outcome(command, None))
        except Exception as failed:
            log.exception("failed: %s", command)
            outcomes.append(Outcome(command, f"{type(failed).__name__}: {failed}"))
    return outcomes, int(any(o.error for o in outcomes))
