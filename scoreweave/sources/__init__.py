"""Table readers, text-to-table extraction and the results store."""
