"""The operators of the inventory, each a function DataFrame -> DataFrame."""
