"""Column functions: text normalisation, identifiers, rules and set similarity."""
