"""Functions of folioscope."""
