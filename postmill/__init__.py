"""Set-at-a-time listing and profile matching on Spark."""
