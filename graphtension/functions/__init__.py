"""Part of graphtension."""
