"""Part of tidewatch: operators."""
