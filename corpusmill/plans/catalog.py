"""The core's queries and their SQL, by name."""

from __future__ import annotations

from corpusmill.plans import cleaning, curation, dedup, evaluation, files, packing, sampling, scanning, streams, vectors  # noqa: F401
from corpusmill.plans.registry import QUERIES, SQL  # noqa: F401
