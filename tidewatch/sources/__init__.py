"""Part of tidewatch: sources."""
