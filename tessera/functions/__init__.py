"""Column functions: scalar semantics of the engine, all inside Catalyst."""
