"""Training-data operators at corpus scale, one module for each, and their queries in ``queries``."""
