"""Readers and writers for batch documents, runs, the pending queue and tables, plus the
adapters that view generic star-schema tables as academic records."""
