"""Streams: logs by file source, incidents and clarifications as keyed state, page versions batch by batch."""
