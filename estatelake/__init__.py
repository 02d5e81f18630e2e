"""estatelake: property-listing analytics written as Spark DataFrame jobs."""
