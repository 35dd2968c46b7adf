"""tieout: a PySpark-native engine for multi-source financial reconciliation."""
