"""The core's queries and their SQL."""

from __future__ import annotations

from docflow.plans import catalogue, corpus

QUERIES = {**catalogue.QUERIES, **corpus.QUERIES}
ORACLE = {**catalogue.ORACLE, **corpus.ORACLE}
