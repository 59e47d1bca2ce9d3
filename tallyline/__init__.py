"""Bank reconciliation as Spark jobs: statements, ledgers, invoices, matching, retrieval, reports."""
