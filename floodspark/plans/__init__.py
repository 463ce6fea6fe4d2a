"""End-to-end builds that chain sources, operators and sinks."""
