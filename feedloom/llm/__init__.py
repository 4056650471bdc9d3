"""Operators on texts: packing, mixing, residue.  Nothing else in the library imports this."""
