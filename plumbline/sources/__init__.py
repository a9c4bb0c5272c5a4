"""Sources and sinks of batches and result tables."""
