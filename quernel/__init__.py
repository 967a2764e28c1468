"""Source-code and text analytics as Spark DataFrame programs."""
