"""Prompt, text, vector and mask analytics as DataFrame-to-DataFrame functions."""
