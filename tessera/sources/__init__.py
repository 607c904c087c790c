"""Sources, sinks and lineage."""
