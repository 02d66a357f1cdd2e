"""Generic operators over event tables: column names and thresholds are arguments."""
