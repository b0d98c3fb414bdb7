"""Feature groups: plans that append scalar columns to an item table, and the registry that folds them."""
