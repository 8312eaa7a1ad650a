"""Writers for the produced tables."""
