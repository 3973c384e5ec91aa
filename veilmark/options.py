"""Job options."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from veilmark.functions.fixed import (
    DEFAULT_LANGUAGE,
    DEFAULT_THRESHOLD,
    DEFAULT_TTL_SECONDS,
)


@dataclass(frozen=True)
class Options:
    """Settings of a redaction job.

    ``salt`` is mixed into token ids; keep it secret and the same for all jobs
    that share a vault.  ``backend`` names the detector: ``presidio`` (analyzer
    results as JSON, the default), ``regex``, ``gcpdlp`` (inspect results as
    JSON) or ``dictionary``.  Empty ``entities`` means all.
    """

    salt: str
    backend: str = "presidio"
    language: str = DEFAULT_LANGUAGE
    entities: tuple[str, ...] = ()
    threshold: float = DEFAULT_THRESHOLD
    ttl_seconds: int = DEFAULT_TTL_SECONDS
    on_error: str = "open"
    result_column: str = "result_json"
    inspect_project: str = ""
    terms: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.ttl_seconds <= 0:
            raise ValueError("ttl_seconds must be positive")
        if self.on_error not in ("open", "closed"):
            raise ValueError("on_error must be 'open' or 'closed'")
        object.__setattr__(self, "entities", tuple(self.entities or ()))
