"""Sources and sinks: documents as records, evidence, content-addressed blobs, pages, ledgers."""
