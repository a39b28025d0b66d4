"""Stream-analytics operators as DataFrame functions, for batch and Structured Streaming alike."""
