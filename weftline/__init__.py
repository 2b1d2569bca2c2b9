"""Analytics on versioned articles, conversations and flash-sale events with PySpark."""
