"""llm."""
