"""Readers that bring raw deliveries into the normalised tables."""
