"""All named queries with their SQL forms."""

from __future__ import annotations

from faintline.plans import aggregates, ingest, models, ordered, relational

ALL = {**models.QUERIES, **ingest.QUERIES, **relational.QUERIES, **aggregates.QUERIES, **ordered.QUERIES}
