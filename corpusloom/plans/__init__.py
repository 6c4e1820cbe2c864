"""The user-facing verbs, each one plan over the operators."""
