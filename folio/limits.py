"""Bounds on untrusted input."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from .errors import InvalidArgument


@dataclass(frozen=True)
class Limits:
    max_size: float = 1 << 30
    max_objects: float = 1_000_000
    max_stream: float = 256 << 20
    max_depth: float = 64
    max_pages: float = 100_000

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not (v == math.inf or (v >= 1 and v == int(v))):
                raise InvalidArgument(f"{f.name} must be a positive whole number or inf", arg=f.name)


#: Fixed bounds of the content walk and of value nesting.
OPERANDS, SAVES, FORM_COST, PARSE_DEPTH, COPY_DEPTH, MAP_RANGES = 64, 64, 256, 32, 2048, 1_000_000
