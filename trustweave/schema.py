"""Column layouts of the metadata and profile tables.

``runs``, ``operations`` and ``scores`` are append-only event tables: the
current state of a run or a score is an aggregate over its events, so no writer
ever updates a row in place.
"""

RUNS = "scope STRING, run_id STRING, info STRING, event STRING, at TIMESTAMP"

OPERATIONS = (
    "scope STRING, run_id STRING, op_seq LONG, src_vars ARRAY<STRING>, "
    "src_idxs ARRAY<STRING>, operation STRING, dst_var STRING, dst_idx STRING, "
    "is_load BOOLEAN, column_types STRING, inspected_columns ARRAY<INT>, "
    "started TIMESTAMP, path STRING, captured BOOLEAN"
)

# How an uncaptured load can be read again; ``columns`` is the schema as JSON.
LOADS = "scope STRING, run_id STRING, dst_var STRING, format STRING, columns STRING"

EDGES = "scope STRING, run_id STRING, dst_idx STRING, src_idx STRING"

BUCKET_SPEC = "scope STRING, var STRING, col_idx INT, base DOUBLE, step DOUBLE"

# ``n`` and ``version`` let a capture that grew be counted on from what it was.
DIST = "scope STRING, var STRING, run_id STRING, col_idx INT, bucket INT, p DOUBLE, n LONG, version LONG"

# One row per profiled column of a capture.  A capture whose column holds no
# usable value has no ``dist`` rows but still counts as a history member.
# ``version`` is how often the capture had grown when it was profiled.
PROFILE = "scope STRING, var STRING, run_id STRING, col_idx INT, n LONG, n_bad LONG, version LONG"

# A capture got more rows; its profile no longer holds.  A growth has a row without
# ``writes`` before its rows are stored, and one that names them afterwards.
GROWTHS = "scope STRING, var STRING, run_id STRING, at TIMESTAMP, growth STRING, writes ARRAY<STRING>"

CONFIDENCE = (
    "scope STRING, var STRING, run_id STRING, col_idx INT, n_history LONG, "
    "jsd DOUBLE, mu DOUBLE, sd DOUBLE, log_density DOUBLE, confidence DOUBLE, "
    "corrupted BOOLEAN, status STRING"
)

SCORES = (
    "scope STRING, run_id STRING, dst_idx STRING, delta DOUBLE, "
    "evaluated_var STRING, at TIMESTAMP"
)
