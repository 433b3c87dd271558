"""Column-level building blocks: tokenizers, value functions, distributions."""
