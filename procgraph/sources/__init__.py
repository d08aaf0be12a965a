"""Readers of project folders and artifact folders."""
