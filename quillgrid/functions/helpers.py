"""What map and reduce functions are given besides ``emit``, and canonical JSON."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOG = logging.getLogger("quillgrid.user")


def total(values: Iterable[float]) -> float:
    return sum(values)


def to_json(value: Any) -> str:
    """JSON text as clients write it: no spaces, members as they are."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def is_array(value: Any) -> bool:
    return isinstance(value, (list, tuple))


def log(message: Any) -> None:
    """A line in the worker's log."""
    _LOG.info(message if isinstance(message, str) else to_json(message))


def canonical(text: Column) -> Column:
    """JSON text without spaces and with members in order; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))
