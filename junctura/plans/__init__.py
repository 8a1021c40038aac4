"""Whole flows, composed from operators; each is one lazy chain unless a model is fitted."""
