"""Card-transaction analytics as DataFrame-to-DataFrame operators on Spark."""
