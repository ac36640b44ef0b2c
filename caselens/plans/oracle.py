"""All SQL checks by query key. Queries without one (the fitted text models) are tested on fixtures."""

from __future__ import annotations

from caselens.plans import oracle_benchmark, oracle_labels, oracle_model, oracle_written

SQL: dict[str, str] = {**oracle_benchmark.SQL, **oracle_labels.SQL, **oracle_model.SQL, **oracle_written.SQL}
