"""Edge sources and sinks."""
