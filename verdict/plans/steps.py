"""What a step can be besides a scorer."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EchoStep:
    """Answers with its input."""

    name: str
    needs_input = True


@dataclass(frozen=True)
class StoreStep:
    """Hands all its inputs, as answers, to the results table."""

    name: str
    needs_input = True
