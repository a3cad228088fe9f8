"""Column functions: spans in a text, checksums, keyed digests."""
