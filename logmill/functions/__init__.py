"""Log engine: functions."""
