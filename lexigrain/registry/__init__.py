"""All registered queries and their SQL twins."""

from __future__ import annotations

from lexigrain.registry import (  # noqa: F401
    dump_queries,
    feed_queries,
    markup_queries,
    row_queries,
    source_queries,
    text_queries,
    topic_queries,
    vocabulary_queries,
)
from lexigrain.registry.core import ORACLES, QUERIES  # noqa: F401
