"""Ready-made plans: column lists and level tables of the housing workflow, and the whole preparation."""
