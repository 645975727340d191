"""Sources and sinks: record files, pages, the ledger, fetching."""
