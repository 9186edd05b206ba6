"""Sessions, row errors and event logs."""
