"""Incremental runs: watermark dedup, late audit, windows, keyed state."""
