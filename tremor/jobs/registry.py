"""Registered queries: name to function of (spark, sf_dir), and name to the SQL that gives the same rows."""

from __future__ import annotations

from tremor.jobs import oracles
from tremor.jobs import queries as q

QUERIES = {n.removeprefix("q_"): f for n, f in vars(q).items() if n.startswith("q_")}
ORACLES = {n: sql for n, sql in oracles.SQL.items() if n in QUERIES}
