"""Part of tidewatch: plans."""
