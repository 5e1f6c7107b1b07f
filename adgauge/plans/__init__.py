"""End-to-end jobs, the views over the test tables and the query catalogue."""
