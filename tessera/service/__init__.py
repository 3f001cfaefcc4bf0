"""The shell around the engine: accounts, HTTP requests and event streams, and tools for agents."""
