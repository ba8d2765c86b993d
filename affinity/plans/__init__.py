"""End-to-end jobs (rec / train / stat) and the registered query catalogue."""
