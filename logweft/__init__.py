"""Pipeline queries over log and event data, compiled to Spark plans."""
