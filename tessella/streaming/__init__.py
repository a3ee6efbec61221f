"""All inputs of this engine are bounded tables: no streaming operator is in scope."""
