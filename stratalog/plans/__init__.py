"""Ready plans over the driver's tables."""
