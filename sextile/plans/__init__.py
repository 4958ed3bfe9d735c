"""Jobs built from the operators, and the views and checks over the given tables."""
