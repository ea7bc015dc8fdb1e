"""Ready-made pipelines."""

from __future__ import annotations

from ..operators.embedding import Embedding
from ..operators.heuristic import Heuristic
from ..operators.marking import Canary, Taint
from ..operators.output import Output
from ..operators.sanitize import Sanitizer
from ..schema import UNTRUSTED
from .pipeline import Pipeline


def strict(key: str | None = None, secret: str | None = None) -> Pipeline:
    """``key`` and ``secret`` make the canaries repeatable."""
    return Pipeline(
        [
            Sanitizer(normalize=True, dehomoglyph=True, strip_zero_width=True, decode_payloads=True),
            Embedding(threshold=0.72),
            Heuristic(preset="strict", threshold=0.3, halt_on_detect=True),
            Taint(UNTRUSTED, "user_input"),
            Canary(kind="hex", length=16, key=key, secret=secret),
            Output(),
        ]
    )


def moderate() -> Pipeline:
    return Pipeline([Sanitizer(normalize=True, dehomoglyph=True), Embedding(threshold=0.72), Heuristic(preset="moderate", threshold=0.5), Taint(UNTRUSTED, "user_input")])


def lenient() -> Pipeline:
    return Pipeline([Heuristic(preset="lenient", threshold=0.7), Embedding(threshold=0.75)])


PRESETS = {"strict": strict, "moderate": moderate, "lenient": lenient}
