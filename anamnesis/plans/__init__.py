"""What users call: operators composed into retrieval, search, listing, write and evaluation jobs."""
