"""Part of the stream and table engine."""
