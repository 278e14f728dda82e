"""Structured Streaming form of the block-wise residual correction."""
