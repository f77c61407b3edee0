"""docloom.plans."""
