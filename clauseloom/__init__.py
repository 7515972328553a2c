"""Contract text analytics on Spark: redaction, splitting, routing, scoring and editing as DataFrame transformations."""
