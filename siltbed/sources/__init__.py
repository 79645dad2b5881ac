"""Change-log segments, immutable runs and snapshots on a Hadoop file system."""
