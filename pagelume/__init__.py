"""Page analytics and corpus building on Spark."""
