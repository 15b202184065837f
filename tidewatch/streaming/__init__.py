"""Part of tidewatch: streaming."""
