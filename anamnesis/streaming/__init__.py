"""Growing inputs as Structured Streaming jobs over the batch plans."""
