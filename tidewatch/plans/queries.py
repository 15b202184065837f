"""All queries of the library but the llm subpackage's, and their SQL."""

from __future__ import annotations

from tidewatch.operators import language, records, rescue, sensing, serving, signals, tracks
from tidewatch.streaming import replay

PAIRS = {**tracks.QUERIES, **sensing.QUERIES, **signals.QUERIES, **rescue.QUERIES, **serving.QUERIES, **records.QUERIES, **language.QUERIES, **replay.QUERIES}
QUERIES = {name: query for name, (query, _) in PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in PAIRS.items() if sql}
