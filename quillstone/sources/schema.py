"""Layouts of assertions: as given, and as stored."""

from __future__ import annotations

#: What a writer gives; JSON objects as strings.
GIVEN = (
    "subject string, predicate string, object string, scope string, owner_id string, observed_at string, valid_from string, valid_until string,"
    " confidence double, provenance_json string, attributes_json string, vector array<double>"
)

#: What is stored, and read again with this schema and no inference; ``scope`` is the partition.
STORED = (
    "assertion_id string, ingest_seq bigint, subject string, predicate string, object string, object_key string, owner_id string,"
    " observed_at string, valid_from string, valid_until string, confidence double, provenance_json string, attributes_json string, text string,"
    " vector array<double>, scope string"
)

STORED_COLUMNS = [f.split()[0] for f in STORED.split(", ")]
