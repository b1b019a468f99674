"""Query catalogues that the driver file registers."""
