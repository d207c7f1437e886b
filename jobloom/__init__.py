"""jobloom: queries over job, event and document tables, written for Spark."""
