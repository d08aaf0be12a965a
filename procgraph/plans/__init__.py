"""Whole flows: project folder to warehouse, warehouse to answers."""
