"""Multi-step plans that put operators together."""
