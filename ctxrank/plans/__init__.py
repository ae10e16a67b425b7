"""Plans built from the operators: the full ranking run and the parameter sweep."""
