"""Part of tidewatch: functions."""
