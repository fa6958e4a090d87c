"""Training-data operators: one module per operator, the driver queries in ``queries``."""
