"""Training-data operators: one module for each, with thin queries in ``queries``."""
