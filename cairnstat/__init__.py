"""Paired-experiment analytics and data preparation as DataFrame plans."""
