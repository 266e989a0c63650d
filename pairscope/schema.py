"""Table schemas as DDL texts; readers use these and never infer."""

from __future__ import annotations

PAIR_ARRAY = "ARRAY<STRUCT<i: INT, j: INT>>"
STRUCTURE = (
    "STRUCT<label: STRING, source_format: STRING, source_value: STRING, "
    f"pairs: {PAIR_ARRAY}, allow_multiple_partners: BOOLEAN>"
)

RECORD = (
    "schema_version STRING, record_id STRING, dataset STRING, rna_id STRING, source STRING, "
    f"sequence STRING, sequence_length INT, truth {STRUCTURE}, prediction {STRUCTURE}, "
    "warnings ARRAY<STRUCT<code: STRING, message: STRING>>, "
    "provenance ARRAY<STRUCT<path: STRING, sha256: STRING>>, parameters MAP<STRING, STRING>, "
    "_corrupt STRING"
)
RECORDS = (
    "record_id STRING, dataset STRING, rna_id STRING, source STRING, sequence STRING, sequence_length INT"
)
PAIRS = ("rna_id STRING, i INT, j INT")
SOURCE_PAIRS = ("rna_id STRING, source STRING, i INT, j INT")
STRUCTURES_TEXT = ("record_id STRING, role STRING, source_format STRING, text STRING")
PAIR_SCORES = ("rna_id STRING, i INT, j INT, score FLOAT")
FOLDS = ("rna_id STRING, fold INT, component_id STRING, component_size INT, sequence_length INT")
EVIDENCE_ITEM = (
    "manifest_id STRING, item_index INT, status STRING, corruption_requested BOOLEAN, "
    "clean_i INT, clean_j INT, i INT, j INT"
)
