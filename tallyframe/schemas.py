"""Schemas of the frames that the operators take and give."""

from __future__ import annotations

#: One row per submission; a retry has the same key and a later receipt.
SUBMISSION = "side string, row_id long, idempotency_key string, txn_id string, amount decimal(18,2), currency string, occurred_at timestamp_ntz, received_at timestamp_ntz"
#: First receipts: what the matcher sees.
RECEIPT = SUBMISSION + ", submissions long"
#: Reconciliation results; one of the two row ids may be null.
RESULT = "gateway_id long, ledger_id long, status string, match_layer string, resolved_at timestamp_ntz, match_latency_ms long, notes string"
#: Requests to close an exception, in the order of (closed_at, seq).
CLOSURE = "exception_id long, resolution_notes string, closed_at timestamp_ntz, seq long"
#: A queue message: which row is to be matched.
MESSAGE = "source string, row_id long, txn_id string, is_duplicate boolean, submissions int"
#: The raw text of a gateway submission's fields, before validation.
GATEWAY_FIELDS = ("txn_id", "amount", "currency", "occurred_at", "gateway_ref")
LEDGER_FIELDS = ("entry_id", "txn_id", "amount", "currency", "occurred_at", "idempotency_key")
