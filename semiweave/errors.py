"""Errors of the library."""

from __future__ import annotations

from typing import Any

# The kinds of errors, each with what its reason carries.
REASONS = {
    "dimension_mismatch": "expected {0}, got {1}",
    "type_mismatch": "expected type {0}, got {1}",
    "unsupported_type": "scalar type {0} is not supported",
    "unsupported_operation": "operation {0} is not supported",
    "invalid_argument": "{0}",
    "index_out_of_bounds": "index {0} is outside {1} of size {2}",
    "mask_type_mismatch": "a {1} mask is needed, got a {0}",
    "unknown_predicate": "no predicate {0}",
    "unknown_semiring": "no semiring {0}",
    "unknown_monoid": "no monoid {0}",
    "unknown_operator": "no operator {0}",
    "empty_predicate_path": "a path needs one predicate at least",
    "empty_collection": "{0} is empty",
}


class GraphError(Exception):
    """reason is a tuple of the kind and its details, for callers to match on."""

    def __init__(self, kind: str, *details: Any, message: str | None = None, context: dict | None = None):
        self.reason = (kind, *details)
        self.message = message
        self.context = context or {}
        super().__init__(format_error(self))


def format_error(error: GraphError) -> str:
    kind, *details = error.reason
    text = f"{kind.replace('_', ' ')}: {REASONS.get(kind, '{0}').format(*details)}" if details or kind in REASONS else kind
    return f"{text} ({error.message})" if error.message else text
