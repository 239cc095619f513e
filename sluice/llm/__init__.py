"""Training-data operators.  Nothing else in ``sluice`` imports this subpackage."""
