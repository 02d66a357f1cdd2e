"""tidemark: event-stream and corpus analytics as lazy Spark plans."""
