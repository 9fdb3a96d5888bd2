"""Sun and shade exposure analytics for walking routes, as Spark DataFrame jobs."""
