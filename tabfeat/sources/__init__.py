"""Reading tables, writing predictions, keeping models."""
