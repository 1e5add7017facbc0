"""Mail archive search and training-data operations on Spark."""
