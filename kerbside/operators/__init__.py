"""Pure DataFrame-to-DataFrame steps; none of them reads or writes storage."""
