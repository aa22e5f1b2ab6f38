"""tallyframe: two-feed payment reconciliation as plain Spark DataFrame operators."""
