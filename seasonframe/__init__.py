"""Season and report analytics as DataFrame operators."""
